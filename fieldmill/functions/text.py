"""Text functions as Catalyst expressions. White space is what Unicode calls so, as in Python's strip."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import plain_keys, plain_strings

_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250))
_PLAIN = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in _ACCENTED}
#: Latin letters that decompose to one ASCII letter, and that letter, in code order.
ACCENT_FROM = "".join(c for c in _ACCENTED if len(_PLAIN[c]) == 1)
ACCENT_TO = "".join(_PLAIN[c] for c in ACCENT_FROM)
#: Decimal digits beyond ASCII, and their values.
DIGITS_FROM = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None)
DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in DIGITS_FROM)


# A fenced JSON object, what closes a thinking part, the default category.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
THINK_END = "</think>"
DEFAULT_CATEGORY = "autre"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")


def strip_think(c: Column) -> Column:
    """What follows the first closing think tag, without white space before it; all if there is none."""
    return let(F.coalesce(c, F.lit("")), lambda t: F.when(F.contains(t, F.lit(THINK_END)), lstrip(F.substring(t, F.locate(THINK_END, t) + len(THINK_END), F.length(t)))).otherwise(t))


def json_candidate(c: Column) -> Column:
    """The part of an output that should be a JSON object: a fenced block's object, else from the
    first { to the last }, else everything; white space outside is gone."""

    def of(text: Column) -> Column:
        fenced = F.regexp_extract(text, FENCED, 1)
        braced = F.regexp_extract(text, r"(?s)^[^{]*(\{.*\})", 1)
        return F.when(fenced != "", strip(fenced)).when(braced != "", strip(braced)).otherwise(text)

    return let(strip(strip_think(c)), of)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _folded(native: Column, exact: Callable[[Column], Column], c: Column) -> Column:
    """native where Latin accents were all that stood between it and ASCII; the rest goes to exact,
    an Arrow UDF, which sees null for every decided text."""
    return F.when(is_ascii(native), native).otherwise(exact(F.when(~is_ascii(native), c)))


def normalize_key(c: Column) -> Column:
    """Letters a-z and digits of a key in lower case, without accents."""
    return F.regexp_replace(_folded(F.translate(F.lower(c), ACCENT_FROM, ACCENT_TO), plain_keys, c), "[^a-z0-9]", "")


def normalize_string(c: Column) -> Column:
    """Stripped, lower case, without accents, white space runs as one space; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.regexp_replace(_folded(F.translate(F.lower(strip(text)), ACCENT_FROM, ACCENT_TO), plain_strings, text), r"[\s\x1c-\x1f]+", " ")


def ascii_digits(c: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9."""
    return F.when(is_ascii(c), c).otherwise(F.translate(c, DIGITS_FROM, DIGITS_TO))


def slug(c: Column) -> Column:
    """A name for folders: lower case, all but letters, digits, dots, underscores and hyphens as one hyphen, run if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9._-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^-+|-+$", ""), F.lit("")), F.lit("run"))


def truncated(c: Column, length: int) -> Column:
    """At most length characters on one line: line breaks as a backslash and n, an ellipsis where cut."""
    flat = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, max(length - 3, 0)), F.lit("..."))).otherwise(flat)


def printable_token(c: Column) -> Column:
    """A token for display: line breaks and tabs escaped, an empty token named."""
    shown = c
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(raw), F.lit(name))
    return F.when(shown == "", F.lit("<empty>")).otherwise(shown)


def message_text(content: Column) -> Column:
    """The text of a message's content (variant): a string as it is; of an array the strings, the
    text of text and output_text parts, and other parts' content where these are strings, joined;
    anything else as JSON."""
    kind = F.schema_of_variant(content)

    def told(p: Column) -> Column:
        text, other = F.try_variant_get(p, "$.text", "variant"), F.try_variant_get(p, "$.content", "variant")
        is_text = F.coalesce(F.try_variant_get(p, "$.type", "string").isin("text", "output_text") & (F.schema_of_variant(text) == "STRING"), F.lit(False))
        return (
            F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
            .when(is_text, F.try_variant_get(text, "$", "string"))
            .when(F.schema_of_variant(other) == "STRING", F.try_variant_get(other, "$", "string"))
        )

    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), told)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "")).otherwise(F.to_json(content))


def tagged(role: Column, content: Column) -> Column:
    """One message of a chat text; other templates take its place as a parameter of chat and prompt."""
    return F.concat(F.lit("<|"), role, F.lit("|>"), F.coalesce(content, F.lit("")))


def chat(messages: Column, end: str = "\n", template: Callable[[Column, Column], Column] = tagged) -> Column:
    """A chat text from an array of struct role, content in order."""
    return F.array_join(F.transform(messages, lambda m: template(m["role"], m["content"])), end)


def messages(instruction: Column, text: Column, output: Column | None = None) -> Column:
    """System, user and (with output) assistant messages; a null output is empty."""
    made = [("system", instruction), ("user", text)] + ([("assistant", F.coalesce(output, F.lit("")))] if output is not None else [])
    return F.array(*(F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in made))


def prompt(instruction: Column, text: Column, suffix: str = "\n<|assistant|>", template: Callable[[Column, Column], Column] = tagged) -> Column:
    """The chat text up to where the assistant's output begins."""
    return F.concat(chat(messages(instruction, text), template=template), F.lit(suffix))


def with_text(df: DataFrame, instruction: str = "instruction", text: str = "input", output: str = "output") -> DataFrame:
    """df with the chat text of its examples as a column text."""
    return df.withColumn("text", chat(messages(F.col(instruction), F.col(text), F.col(output))))


def chars(c: Column) -> Column:
    """Code points of a text as ids: the character tokenizer used for checks."""
    return F.when(F.length(c) > 0, F.transform(F.split(c, ""), lambda x: F.ascii(x))).otherwise(F.array().cast("array<int>"))


def corpus_of(c: Column, rules: list[tuple[str, list[list[str]]]], default: str) -> Column:
    """The name of the first rule that a text fits. A rule is a name and alternatives, each a list
    of substrings that all must be there. Null texts fit none."""
    out = F.lit(default)
    for name, ways in reversed(rules):
        fits = F.lit(False)
        for parts in ways:
            all_ = F.lit(True)
            for p in parts:
                all_ = all_ & F.contains(c, F.lit(p))
            fits = fits | all_
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def json_keys(c: Column) -> Column:
    """The top-level keys of a JSON object's text in their order; null for what isn't an object."""
    return F.json_object_keys(c)


def json_kinds(c: Column) -> Column:
    """struct(key, kind) of the top-level fields of a JSON object's text, in the order of the keys."""
    fields = F.from_json(c, "map<string,variant>")
    return F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k.alias("key"), F.regexp_extract(F.schema_of_variant(F.element_at(fields, k)), "^[A-Z]+", 0).alias("kind")))


def category_of(output: Column, field: str = "category", default: str = DEFAULT_CATEGORY) -> Column:
    """A top-level field of a JSON text; default where the text can't be parsed or lacks the field.
    A JSON null stays null."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(output), f"$.{field}", "variant"))
    value = F.get_json_object(output, f"$.{field}")
    return F.when(kind == "VOID", F.lit(None).cast("string")).otherwise(F.coalesce(value, F.lit(default)))
