"""Numbers far inside words without spaces."""

import pyarrow as pa

from tidemark.llm import pii
from tidemark.llm.textcore import Texts


def test_numbers_behind_the_64th_character():
    long = "https://example.com/" + "some/path/" * 12
    texts = [f"see {long}?phone=706-555-3138&x=y there", f"<a><b>{'<p>text</p>' * 20}ssn:123-45-6789</b></a>", "é文" * 80 + "(706)555-3138" + "文字" * 80]
    found = pii.find(Texts.of(pa.array(texts)), pii.default_field())
    assert [[(k, t[a:b]) for k, a, b in f] for t, f in zip(texts, found, strict=True)] == [[("phone", "706-555-3138")], [("ssn", "123-45-6789")], [("phone", "(706)555-3138")]]
