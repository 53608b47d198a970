"""Column functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of request types and the types, matched in this order.
REQUEST_TYPES: tuple[tuple[str, str], ...] = (
    (r"openstackclient\.compute\.v2\.server\.CreateServer\.take_action", "ServerCreate"),
    (r"openstackclient\.compute\.v2\.server\.ListServer\.take_action", "ServerList"),
    (r"openstackclient\.compute\.v2\.server\.DeleteServer\.take_action", "ServerDelete"),
    (r"openstackclient\.network\.v2\.floating_ip\.CreateFloatingIP\.take_action_network", "FloatingIPCreate"),
    (r"openstackclient\.network\.v2\.floating_ip\.ListFloatingIP\.take_action_network", "FloatingIPList"),
    (r"openstackclient\.network\.v2\.floating_ip\.DeleteFloatingIP\.take_action_network", "FloatingIPDelete"),
    (r"novaclient\.v2\.usage\.UsageManager\.list", "UsageList"),
)

SEPARATOR = "\x1f"


def request_type(tracepoint: Column, types: Sequence[tuple[str, str]] = REQUEST_TYPES) -> Column:
    """The type of the first pattern that the tracepoint matches; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(types):
        out = F.when(tracepoint.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def hyphenated(hex32: Column) -> Column:
    """32 hex digits as a UUID in lower case."""
    return F.regexp_replace(F.lower(hex32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")


def uuid(text: Column) -> Column:
    """A UUID with or without hyphens, in one form; null if it is none."""
    bare = F.lower(F.regexp_replace(text, "-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), hyphenated(bare))


def hex_id(text: Column) -> Column:
    """A hex id as a UUID: its first eight bytes, zeros after; "0" is the zero UUID."""
    return hyphenated(F.rpad(F.when(text == "0", F.lit("")).otherwise(F.substring(text, 1, 16)), 32, "0"))


def event_uuid(number: Column) -> Column:
    """A signed decimal event id as a UUID: big-endian in the first eight bytes."""
    return hyphenated(F.rpad(F.lpad(F.hex(number.cast("bigint")), 16, "0"), 32, "0"))


def split_objects(blob: Column) -> Column:
    """The JSON objects of a blob in which they stand one after another; those with }{ inside a string aren't told apart."""
    inner = F.split(F.substring(blob, F.lit(2), F.length(blob) - 2), r"\}\{")
    return F.when(F.length(blob) > 1, F.transform(inner, lambda x: F.concat(F.lit("{"), x, F.lit("}")))).otherwise(F.array().cast("array<string>"))


def path_hash(tracepoints: Column) -> Column:
    """The same for equal sequences of tracepoints, whatever else differs."""
    return F.sha2(F.array_join(tracepoints, SEPARATOR), 256)


def matched(long: Column, short: Column) -> Column:
    """How many of short's elements, in order, a greedy walk over long meets."""
    return F.aggregate(long, F.lit(0), lambda n, x: n + F.when((n < F.size(short)) & (F.get(short, n) == x), 1).otherwise(0))


def contains(long: Column, short: Column) -> Column:
    """Whether short comes from long by leaving elements out. Sizes are looked at first."""
    return (F.size(long) >= F.size(short)) & (matched(long, short) == F.size(short))


def path_text(path: Column) -> Column:
    """A path as text, each element between separators of its own, for contains_text()."""
    return F.concat(F.lit(SEPARATOR), F.array_join(path, SEPARATOR * 2), F.lit(SEPARATOR))


def contains_text(long_text: Column, short: Column) -> Column:
    """contains() on path_text() of the long path: one search of the text for each element of the short one."""
    token = lambda t: F.concat(F.lit(SEPARATOR), t, F.lit(SEPARATOR))
    at = F.aggregate(short, F.lit(1), lambda p, t: F.when(p > 0, F.when(F.position(token(t), long_text, p) > 0, F.position(token(t), long_text, p) + F.length(t) + 2).otherwise(0)).otherwise(0))
    return at > 0


#: Letters that stand for tracepoints, by a hash; a shared one makes its paths odd.
_FIRST, _LETTERS = 0x4E00, 20_000


def letter(tracepoint: Column) -> Column:
    """One letter's number for a tracepoint, in four hex digits."""
    return F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(tracepoint), F.lit(_LETTERS)) + _FIRST), 4, "0"))


def letters(path: Column) -> Column:
    """A path as a word with a letter for each tracepoint."""
    return F.decode(F.unhex(F.array_join(F.transform(path, letter), "")), "UTF-16BE")


def within(word: Column) -> Column:
    """A pattern of the words that contain this one with other letters between: it reads each letter once."""
    return F.concat(F.lit("^"), F.regexp_replace(word, "(.)", "[^$1]*+$1"))


def following(word: Column) -> Column:
    """A pattern of a text's words, each between bars, that come from this one by leaving letters out: it takes each letter that is next."""
    return F.concat(F.lit(r"\|("), F.regexp_replace(word, "(.)", r"$1?+"), F.lit(r")(?=\|)"))


def positions(long: Column, short: Column) -> Column:
    """The positions, from 0, in long at which the greedy walk meets short's elements."""
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))
    step = lambda s, x: F.when(
        (F.size(s["at"]) < F.size(short)) & (F.get(short, F.size(s["at"])) == x), F.struct((s["i"] + 1).alias("i"), F.concat(s["at"], F.array(s["i"])).alias("at"))
    ).otherwise(F.struct((s["i"] + 1).alias("i"), s["at"].alias("at")))
    return F.aggregate(long, start, step, lambda s: s["at"])


def whole_double(x: Column) -> Column:
    """A decimal of 0 or more as a double, by three parts of twelve digits that doubles hold exactly, so that every engine rounds alike."""
    base = F.lit(10**12).cast("decimal(13,0)")
    low = x % base
    rest = ((x - low) / base).cast("decimal(38,0)")
    mid = rest % base
    high = ((rest - mid) / base).cast("decimal(38,0)")
    return (high.cast("double") * 1e12 + mid.cast("double")) * 1e12 + low.cast("double")


def exact_variance(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from a count, a sum and a sum of squares of integers (decimal(38,0)), rounded once or twice only: sums are centred on the integer mean before they leave exact arithmetic. Holds while the squares' sum is under 1e37."""
    q = F.floor(total / n).cast("decimal(20,0)")
    centred = squares - 2 * (q * total).cast("decimal(38,0)") + ((q * q).cast("decimal(38,0)") * n).cast("decimal(38,0)")
    rest = (total - q * n).cast("double")
    return (whole_double(centred.cast("decimal(38,0)")) - rest * rest / n) / n
