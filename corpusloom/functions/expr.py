"""Column expressions: text flags, languages, numbers, JSON, segment and code lists.

Everything here is built from Spark's own functions and stays inside code generation or
higher-order functions; none of it runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as true, and the wider set of the stage statistics.
TRUE_WORDS = ("1", "true", "yes", "y")
TRUE_WORDS_WIDE = ("1", "true", "yes", "y", "done", "ok")
#: Two-letter language codes and their three-letter forms.
LANGUAGE_ALIASES = {"en": "eng", "es": "spa", "de": "deu", "fr": "fra", "it": "ita", "pt": "por", "nl": "nld", "ca": "cat", "gl": "glg"}
#: Language tags of the text encoder and names of the speech encoders.
TEXT_LANGUAGES = {"en": "eng_Latn", "eng": "eng_Latn", "de": "deu_Latn", "deu": "deu_Latn", "es": "spa_Latn", "spa": "spa_Latn"}
SPEECH_ENCODERS = {
    "en": "sonar_speech_encoder_eng", "eng": "sonar_speech_encoder_eng", "de": "sonar_speech_encoder_deu",
    "deu": "sonar_speech_encoder_deu", "es": "sonar_speech_encoder_spa", "spa": "sonar_speech_encoder_spa",
}
#: Names of languages for the recogniser.
RECOGNISER_LANGUAGES = {"en": "english", "eng": "english", "es": "spanish", "spa": "spanish", "de": "german", "deu": "german"}
#: What an inferring scan reads as missing.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
LAST_NUMBER = r"[-+]?\d+(?:\.\d+)?"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """Null is false; numbers count by their text, so 1 is true and 1.0 isn't."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*words), F.lit(False))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def normalize_language(c: Column) -> Column:
    """Three-letter code; unknown names pass through in lower case, null becomes empty."""
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(_lookup(LANGUAGE_ALIASES, key), key)


def text_language(c: Column) -> Column:
    """Tag of the text encoder; an unknown tag passes through as it is."""
    tag = strip(c)
    return F.coalesce(_lookup(TEXT_LANGUAGES, F.lower(tag)), tag)


def speech_encoder(c: Column) -> Column:
    """Name of the speech encoder; an unknown tag is an error, a null stays null."""
    key = F.lower(strip(c))
    unknown = F.raise_error(F.concat(F.lit("no speech encoder for language "), key))
    return F.when(key.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(_lookup(SPEECH_ENCODERS, key), unknown))


def recogniser_language(c: Column) -> Column:
    """Name of a language for the recogniser; an unknown one passes through in lower case."""
    key = F.lower(strip(c))
    return F.coalesce(_lookup(RECOGNISER_LANGUAGES, key), key)


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def replace_all(c: Column, patterns: dict[str, str]) -> Column:
    """Literal replacements, the longest pattern first."""
    ordered = sorted(patterns.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ordered, c)


def captured(c: Column, pattern: str, groups: bool) -> Column:
    """First match in multi-line mode: its first group, or all of it; null if there is none."""
    found = F.regexp_extract_all(c, F.lit(f"(?m){pattern}"), F.lit(1 if groups else 0))
    return F.get(found, F.lit(0))


def one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def stem(c: Column) -> Column:
    name = F.substring_index(c, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def to_number(c: Column) -> Column:
    """Double, or null for anything that isn't a finite plain number."""
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def combine(a: Column, b: Column, how: str) -> Column:
    """Mean or minimum of both sides; null if either is missing."""
    a, b = no_nan(a), no_nan(b)
    if how == "mean":
        return (a + b) / 2
    if how == "min":
        return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    raise ValueError(f"combine by mean or min, not {how}")


def compliance(a: Column, b: Column) -> Column:
    """Smaller over larger; null where one is missing or not positive."""
    a, b = no_nan(a), no_nan(b)
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def abs_log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.abs(F.ln(b / a)))


def ramp(x: Column, start: float, end: float, low: float, high: float) -> Column:
    """Linear from ``low`` at ``start`` to ``high`` at ``end``, level outside."""
    part = F.least(F.greatest((x - start) / float(end - start), F.lit(0.0)), F.lit(1.0))
    return low + (high - low) * part


def target_rows(x: Column) -> Column:
    """Rows that a length needs, at least one."""
    return F.greatest(F.lit(1), (x + 0.999).cast("int"))


def nested_text(json: Column, key: str) -> Column:
    """A dotted key's text; within a list, that of the first element which has it."""
    head, _, tail = key.partition(".")
    here = F.get_json_object(json, f"$.{head}")
    elements = F.from_json(json, "array<string>")
    inside = F.get(F.filter(F.transform(elements, lambda e: F.get_json_object(e, f"$.{head}")), lambda v: v.isNotNull()), F.lit(0))
    found = F.when(F.substring(F.ltrim(json), 1, 1) == "[", inside).otherwise(here)
    return nested_text(found, tail) if tail else found


def shallow_text(json: Column, key: str) -> Column:
    """A top-level key's text, else that of the first nested object which has it."""
    nested = F.map_values(F.from_json(json, "map<string,string>"))
    deeper = F.get(F.filter(F.transform(nested, lambda v: F.get_json_object(v, f"$.{key}")), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(F.get_json_object(json, f"$.{key}"), deeper)


def utterance_is_valid(json: Column) -> Column:
    """Parses, has a text and at least one word that isn't blank."""
    u = F.from_json(json, "text string, words array<string>")
    return F.coalesce(u["text"].isNotNull() & F.exists(u["words"], lambda w: strip(w) != ""), F.lit(False))


def vad_segments(c: Column) -> Column:
    """``"0.1:1.5 2.0:3.2"`` as start/end structs; tokens that can't be read, or don't end after their start, are left out."""
    tokens = F.filter(F.split(strip(c), r"\s+"), lambda t: F.contains(t, F.lit(":")))
    parsed = F.transform(tokens, lambda t: F.struct(to_number(F.substring_index(t, ":", 1)).alias("s"), to_number(F.regexp_replace(t, r"^[^:]*:", "")).alias("e")))
    return F.filter(parsed, lambda x: F.coalesce(x["e"] > x["s"], F.lit(False)))


def vad_span(c: Column) -> Column:
    """Latest end less earliest start, null without a segment."""
    segments = vad_segments(c)
    return F.array_max(F.transform(segments, lambda x: x["e"])) - F.array_min(F.transform(segments, lambda x: x["s"]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def code_stack(codes: Column, shape: Column, levels: int | None = None, order: list[int] | None = None) -> Column:
    """Flat codes with a shape ``1xQxF`` as an array of levels; null where the shape or the length is wrong.

    ``levels`` keeps the first ones and is null where there are fewer; ``order`` puts the
    levels with these numbers first, the others follow from the end of ``order`` on.
    """
    dims = F.transform(F.split(F.replace(F.lower(strip(shape)), F.lit(" "), F.lit("")), "x"), lambda d: d.try_cast("int"))
    flat = F.transform(F.filter(F.split(strip(codes), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("int"))

    def cut(parts: Column) -> Column:
        flat, q, f = parts["flat"], parts["q"], parts["f"]
        wanted = q if levels is None else F.lit(levels)
        at = F.sequence(F.lit(0), wanted - 1)
        if order is not None:
            at = F.concat(F.array(*[F.lit(k) for k in order]), F.slice(at, len(order) + 1, F.greatest(wanted, F.lit(0))))
        stack = F.transform(at, lambda i: F.slice(flat, i * f + 1, f))
        return F.when((parts["size"] == 3) & (parts["one"] == 1) & (F.size(flat) == q * f) & (f > 0) & (wanted > 0) & (wanted <= q), stack)

    return bound(F.struct(flat.alias("flat"), F.size(dims).alias("size"), F.get(dims, F.lit(0)).alias("one"), F.get(dims, F.lit(1)).alias("q"), F.get(dims, F.lit(2)).alias("f")), cut)


def code_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: x.cast("string")), " ")


def transpose(rows: Column) -> Column:
    width = F.size(F.get(rows, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i))))


def frames_first(stack: Column, levels: int) -> Column:
    """A stack of levels, or of frames, as frames; null where neither side has ``levels`` parts."""
    width = F.size(F.get(stack, F.lit(0)))
    return F.when((F.size(stack) == levels) & (width != levels), transpose(stack)).when(width == levels, stack)


def wrapped(codes: Column, begin: int, end: int) -> Column:
    return F.concat(F.array(F.lit(begin)), codes, F.array(F.lit(end)))


def unwrapped(codes: Column) -> Column:
    return F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 2, F.lit(0)))


def padded(codes: Column, length: Column, value: int) -> Column:
    return F.concat(codes, F.array_repeat(F.lit(value), F.greatest(length - F.size(codes), F.lit(0))))


def pad_mask(codes: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), length), lambda i: i <= F.size(codes))


def inverse_order(order: Column) -> Column:
    """Where each place went under a permutation of 0..n-1."""
    placed = F.sort_array(F.transform(order, lambda x, i: F.struct(x.alias("to"), i.alias("at"))))
    return F.transform(placed, lambda p: p["at"])


def within_budget(tokens: Column, budget: int, begin: int, end: int, extra: tuple[int, ...] = (), content: tuple[int, int] | None = None, closed: bool = False) -> Column:
    """A token sequence of at most ``budget``: begin, extras, the first tokens that fit, end.

    With ``content`` the tokens stand between its two signs, and the end only if ``closed``.
    """
    before = [begin, *extra, *([content[0]] if content else [])]
    after = ([content[1]] if content else [end]) + ([end] if content and closed else [])
    structural = (3 if content else 2) + closed + len(extra)
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.concat(ints(before), F.slice(tokens, 1, max(0, budget - structural)), ints(after))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array as text, in order."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(grams)


def repeated_ngram_count(tokens: Column, n: int) -> Column:
    """How many n-grams of an array it had before."""
    return bound(ngrams(tokens, n), lambda g: F.size(g) - F.size(F.array_distinct(g)))


def banned_continuations(tokens: Column, n: int) -> Column:
    """The tokens that would repeat an n-gram, in the order of its occurrences, each once."""
    size = F.size(tokens)
    if n == 1:
        return F.array_distinct(tokens)
    parts = F.struct(tokens.alias("t"), F.slice(tokens, F.greatest(size - n + 2, F.lit(1)), n - 1).alias("last"))
    places = lambda p: F.filter(F.sequence(F.lit(1), F.size(p["t"]) - n + 1), lambda i: F.slice(p["t"], i, n - 1) == p["last"])
    found = bound(parts, lambda p: F.array_distinct(F.transform(places(p), lambda i: F.element_at(p["t"], i + n - 1))))
    return F.when(size >= n, found).otherwise(F.slice(tokens, 1, 0))


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def bracketed(c: Column) -> Column:
    """``[a, b ,]`` as ``[a,b]``; other text only loses the blanks around it."""
    inner = F.array_join(F.filter(F.transform(F.split(F.regexp_extract(strip(c), r"(?s)^\[(.*)\]$", 1), ","), strip), lambda x: x != ""), ",")
    return F.when(strip(c).rlike(r"(?s)^\[.*\]$"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(strip(c))


def override(command: Column, key: str) -> Column:
    """The value of ``key=value`` or ``+key=value`` in a command, without quotes; null if there is none."""
    found = F.regexp_extract_all(command, F.lit(rf"(?:^|\s)\+?\Q{key}\E=([^\s]+)"), F.lit(1))
    return F.regexp_replace(F.get(found, F.lit(0)), "^[\"']+|[\"']+$", "")


def with_override(command: Column, key: str, value: Column) -> Column:
    """The command with another value in the first such place; without one it is an error."""
    parts = rf"(?s)^(.*?)(\+?\Q{key}\E=)([^\s]+)(.*)$"
    missing = F.raise_error(F.concat(F.lit(f"no override {key} in "), command))
    group = lambda k: F.regexp_extract(command, parts, k)
    return F.when(command.rlike(parts), F.concat(group(1), group(2), value, group(4))).otherwise(missing)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing, empty or zero, or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))


def peak_normalized(samples: Column) -> Column:
    """NaN and infinite samples become 0; then everything is divided by a peak above 1."""
    finite = F.transform(samples, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))
    peak = F.array_max(F.transform(finite, lambda x: F.abs(x)))
    return F.when(peak > 1.0, F.transform(finite, lambda x: x / peak)).otherwise(finite)


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
