"""Small scalar functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of apply results.
RESULT_CODES = {"ok": 0, "conflict": 1, "stale": 2, "empty_key": 3}
#: Names of operations in logs, and of what rows of histories, checks and observations hold.
OPS = {1: "PUT", 2: "DELETE"}
KINDS = ["PUT", "DELETE", "GET"]
OUTCOMES = ["OK", "FAILED", "INCOMPLETE"]
STATUSES = ["VALID", "VIOLATION", "INCONCLUSIVE"]
ROLES = ["follower", "candidate", "leader"]


def named(value: Column, names: dict, otherwise: Column | None = None) -> Column:
    """Name of a code; an error for an unknown one unless there is something else to give."""
    out = None
    for code, name in names.items():
        out = F.when(value == code, name) if out is None else out.when(value == code, name)
    told = F.concat(F.lit("unknown value "), F.coalesce(value.cast("string"), F.lit("null")))
    return out.otherwise(F.raise_error(told) if otherwise is None else otherwise)


def parsed(value: Column, names: list[str]) -> Column:
    """The one of ``names`` that a text stands for, whatever its case; an error, with the text in it, for any other."""
    low = F.lower(F.trim(value))
    out = F.when(low == names[0].lower(), names[0])
    for n in names[1:]:
        out = out.when(low == n.lower(), n)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown value "), F.coalesce(value, F.lit("null")))))


def parse_peers(df: DataFrame, column: str) -> DataFrame:
    """Rows (id, grpc_addr, http_addr) of lists ``id=grpc|http,id=grpc|http``; blanks are passed over."""
    item = df.select(F.explode(F.split(column, ",")).alias("_p")).select(F.trim("_p").alias("_p")).where("_p <> ''")
    after = F.split_part("_p", F.lit("="), F.lit(2))
    return item.select(F.trim(F.split_part("_p", F.lit("="), F.lit(1))).alias("id"), F.trim(F.split_part(after, F.lit("|"), F.lit(1))).alias("grpc_addr"), F.trim(F.split_part(after, F.lit("|"), F.lit(2))).alias("http_addr"))


def origins(value: Column) -> Column:
    """Trimmed entries of a comma-separated list, blanks left out."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def valid_address(value: Column) -> Column:
    """host:port with a port of 1 to 65535; the host may be empty or in brackets."""
    port = F.regexp_extract(value, r":([0-9]{1,5})$", 1)
    return value.rlike(r"^(\[[0-9a-fA-F:]+\]|[^:\s]*):[0-9]{1,5}$") & F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))


def wildcard_host(value: Column) -> Column:
    return value.rlike(r"^(|0\.0\.0\.0|\[::\]|\*):[0-9]+$")


def log_level(value: Column) -> Column:
    """debug, info, warn or error; info for anything else."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("debug", "warn", "error"), low).when(low == "warning", "warn").otherwise("info")


def bearer(value: Column) -> Column:
    """Token of a bearer header, else null."""
    return F.nullif(F.regexp_extract(value, r"^[Bb]earer ([^\s]+)$", 1), F.lit(""))


def base_url(value: Column) -> Column:
    """With a scheme and without slashes at the end."""
    return F.regexp_replace(F.when(F.instr(value, "://") > 0, value).otherwise(F.concat(F.lit("http://"), value)), "/+$", "")


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MiB", n / (1 << 20))).otherwise(F.format_string("%.1f GiB", n / (1 << 30)))


def value_type(json: Column) -> Column:
    """string, number, boolean, null, object or array, by the first character of a JSON value."""
    c = F.substring(F.trim(json), 1, 1)
    return F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")


def describe(op: dict[str, Column]) -> Column:
    """Line of text for an operation (id, client, kind, key, value, invoke, complete, outcome, found, result, err)."""
    text = lambda c: op[c].cast("string")
    quoted = lambda c: F.concat(F.lit('"'), op[c], F.lit('"'))
    value = F.when(op["kind"] == "PUT", F.concat(F.lit(" value="), quoted("value"))).otherwise("")
    end = F.when(op["outcome"] == "INCOMPLETE", "?").otherwise(text("complete"))
    got = F.when(op["found"], F.concat(F.lit(" found="), quoted("result"))).otherwise(" not found")
    fine = F.when(op["kind"] == "GET", F.concat(F.lit("OK"), got)).otherwise("OK")
    outcome = F.when(op["outcome"] == "INCOMPLETE", "INCOMPLETE").when(op["outcome"] == "FAILED", F.concat(F.lit("FAILED: "), op["err"])).otherwise(fine)
    return F.concat(text("id"), F.lit(": client "), text("client"), F.lit(" "), op["kind"], F.lit("("), quoted("key"), F.lit(")"), value, F.lit(" from "), text("invoke"), F.lit(" to "), end, F.lit(", "), outcome)


def shortest_text(x: float) -> str:
    """The shortest text that reads back as the same number: digits as they are from 0.0001 to below 1000000, else with an exponent of two digits at least."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    mantissa, _, power = f"{Decimal(repr(x)):e}".partition("e")
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits, exp = (whole + part).rstrip("0") or "0", int(power)
    sign = "-" if mantissa.startswith("-") else ""
    if digits == "0":
        return sign + "0"
    if exp < -4 or exp >= 6:
        return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{exp:+03d}"
    if exp < 0:
        return f"{sign}0.{'0' * (-exp - 1)}{digits}"
    return f"{sign}{digits[: exp + 1].ljust(exp + 1, '0')}{'.' * (len(digits) > exp + 1)}{digits[exp + 1 :]}"


def shortest(value: Column) -> Column:
    """``shortest_text`` of a column, batch by batch: older Java runtimes do not always print the shortest digits."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(shortest_text, na_action=None)

    return F.when(value.isNotNull(), run(F.coalesce(value.cast("double"), F.lit(0.0))))


def padded(prefix: str, n: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"))
