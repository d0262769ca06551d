"""Text functions: identifiers, literals, sizes, redaction and rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules of destructive commands, in order; the first that matches names the command.
DESTRUCTIVE = (
    ("SQL DROP", r"(?i)\bdrop\s+(table|database|schema|view|materialized\s+view|index|sequence|function|procedure|trigger|type|extension|owned|role|user|column)\b"),
    ("SQL TRUNCATE", r"""(?i)\btruncate\s+(table\s+)?["'\w]"""),
    ("SQL DELETE without WHERE", r"""(?i)\bdelete\s+from\s+[\w."]+\s*(;|$|["'])"""),
    ("dropdb", r"(^|[\s;&|(])dropdb\s"),
    ("terraform destroy", r"\b(terraform|tofu)\s+(.*\s)?destroy\b|\b(terraform|tofu)\s+apply\s+(.*\s)?-destroy\b"),
    ("prisma migrate reset", r"\bprisma\s+migrate\s+reset\b"),
    ("prisma db push --force-reset", r"\bprisma\s+db\s+push\b.*--force-reset\b"),
    ("supabase db reset", r"\bsupabase\s+db\s+reset\b"),
    ("rails db:drop / db:reset", r"\b(rails|rake)\s+(.*\s)?db:(drop|reset|schema:load|purge)\b"),
    ("django flush", r"\bmanage\.py\s+(flush|reset_db)\b"),
)


def first_rule(text: Column, rules=DESTRUCTIVE) -> Column:
    """Name of the first rule that a text matches, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def identifier_parts(name: Column) -> Column:
    """Parts of a dotted name; dots within double quotes do not part, doubled quotes are one."""
    raw = F.regexp_extract_all(name, F.lit(r'("(?:[^"]|"")*"|[^."]+)'), F.lit(1))
    unquoted = lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)
    return F.transform(raw, unquoted)


def quoted_identifier(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def quoted_literal(c: Column) -> Column:
    return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


#: Escapes of a MySQL string.
MYSQL_ESCAPES = (("\\", "\\\\"), ("\0", "\\0"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z"))


def mysql_escaped(c: Column) -> Column:
    for plain, escaped in MYSQL_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def mysql_unescaped(c: Column) -> Column:
    """The inverse of mysql_escaped; a backslash before any other character stands for the character."""
    marker = "\ue000"
    c = F.replace(c, F.lit("\\\\"), F.lit(marker))
    for plain, escaped in MYSQL_ESCAPES[1:]:
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return F.replace(F.replace(c, F.lit("\\"), F.lit("")), F.lit(marker), F.lit("\\"))


UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parsed_size(c: Column) -> Column:
    """Bytes of `16MB`, `1GB`, `512` and the like, in binary units; null where unreadable."""
    shape = r"^\s*(\d+)\s*([kKmMgGtT]?)[bB]?\s*$"
    unit = F.upper(F.regexp_extract(c, shape, 2))
    factor = F.lit(None).cast("long")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value).cast("long")).otherwise(factor)
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).cast("long") * factor)


def shown_size(c: Column) -> Column:
    """Bytes in the largest binary unit of which there is one, with one decimal rounded down."""
    text = F.concat(c.cast("string"), F.lit(" B"))
    for name, factor in list(UNITS.items())[1:]:
        tenths = F.floor(c * 10 / factor).cast("long")
        text = F.when(c >= factor, F.concat((tenths - tenths % 10).cast("long").__truediv__(10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}iB"))).otherwise(text)
    return text


def redacted(c: Column) -> Column:
    """Passwords out of URLs and key=value pairs."""
    return F.regexp_replace(F.regexp_replace(c, r"(://[^:/@\s]+):[^@\s]+@", "$1:***@"), r"(?i)(password\s*=\s*)\S+", "$1***")


def shortened_duration(c: Column) -> Column:
    """`1h0m0s` as `1h`, `5m0s` as `5m`."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[hm])0s$", ""), r"(?<=h)0m$", "")


def last_lines(c: Column, most: int) -> Column:
    """The last `most` characters from a line break on, behind `...` if something was left out."""
    tail = F.right(c, F.lit(most))
    cut = F.when(F.contains(tail, F.lit("\n")), F.substring(tail, F.locate("\n", tail) + 1, F.length(tail))).otherwise(tail)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.lit("..."), cut))


def provider(host: Column, suffixes: dict[str, str]) -> Column:
    """The provider whose domain a host is or lies in; a domain elsewhere in the name does not count."""
    found = F.lit(None).cast("string")
    for suffix, name in reversed(suffixes.items()):
        found = F.when((F.lower(host) == suffix) | F.endswith(F.lower(host), F.lit("." + suffix)), name).otherwise(found)
    return found


def pack_time(seconds: Column, ordinal: Column) -> Column:
    return F.shiftleft(seconds.cast("long"), 32) + ordinal.cast("long")


def unpack_time(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 32), packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def segment_name(timeline: Column, number: Column, per_log: int = 256) -> Column:
    """Timeline, log and segment as three eight-digit hex numbers."""
    part = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.concat(part(timeline), part(F.floor(number / per_log).cast("long")), part(F.pmod(number, F.lit(per_log))))


def segment_number(name: Column, per_log: int = 256) -> Column:
    part = lambda a: F.conv(F.substring(name, a, 8), 16, 10).cast("long")
    return F.when(name.rlike("^[0-9A-F]{24}$"), part(9) * per_log + part(17))


def round_cents(c: Column) -> Column:
    """Half away from zero on the binary product, alike on every engine."""
    return F.floor(F.abs(c) * 100 + 0.5) / 100 * F.signum(c)


def egress(bytes_: Column, runs_a_month: Column, included_gb: float, rate: float) -> tuple[Column, Column]:
    """Gigabytes a month and their price beyond what is included."""
    gb = runs_a_month * bytes_ / F.lit(1e9)
    return gb, round_cents(F.greatest(gb - included_gb, F.lit(0.0)) * rate)


def known_keys_only(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object holds no other keys."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, keys)))) == 0, F.lit(False))


def valid_note(key: Column, value: Column) -> Column:
    """A note's key is a short name, its value up to 256 characters without control characters."""
    return F.coalesce(key.rlike(r"^[a-z0-9][a-z0-9_.-]{0,62}$") & (F.length(value) <= 256) & ~value.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """`1 file`, `3 files`."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))
