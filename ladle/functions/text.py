"""Column functions over titles, URLs, durations, ingredient lines and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Unit words of an ingredient line; vulgar fractions and their values.
UNITS = ["gram", "grams", "g", "kg", "kilogram", "cup", "cups", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp", "ml", "liter", "liters", "piece", "pieces", "pinch", "whole", "medium", "large", "small"]
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 0.33, "⅔": 0.67}
_UNIT = r"(?i)\b(" + "|".join(UNITS) + r")\b"
_DIGITS, _BLANKS = "0123456789", " \t\n\r\f\v"
#: What a quantity may be written with; of the eighths no value is known.
_NUMERALS = _DIGITS + "".join(FRACTIONS) + "⅛⅜⅝⅞"


def normalize_title(t: Column) -> Column:
    """Lower case without marks, spaces collapsed; letters of any script stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def canonical_title(t: Column) -> Column:
    return F.initcap(normalize_title(t))


def slugify(t: Column) -> Column:
    plain = F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a letter of b at a time in one bit string."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _fuzz(s: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else round(200 * _lcs(a, b) / max(len(a) + len(b), 1)) for a, b in zip(s, u)], dtype="Int32")  # half to even


def fuzz_ratio(a: Column, b: Column) -> Column:
    """round(100 * 2 * LCS / (|a| + |b|)); 0 if either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(_fuzz(a, b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either array is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int"), F.lit(0))


def parse_iso_duration(s: Column) -> Column:
    """Minutes of PT..H..M; null without PT; seconds don't count."""
    return F.when(s.rlike("PT"), _number(s, r"PT(\d+)H") * 60 + _number(s, r"PT(?:\d+H)?(\d+)M"))


def parse_iso_duration_seconds(s: Column) -> Column:
    return F.coalesce(F.when(s.rlike("PT"), _number(s, r"PT(\d+)H") * 3600 + _number(s, r"PT(?:\d+H)?(\d+)M") * 60 + _number(s, r"PT(?:\d+H)?(?:\d+M)?(\d+)S")), F.lit(0))


def parse_servings(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("int")


def _without(text: Column, chars: str) -> tuple[Column, Column]:
    """The run of such characters that text begins with, and what follows it."""
    rest = F.ltrim(text, F.lit(chars))
    return F.left(text, F.length(text) - F.length(rest)), rest


def _read_quantity(line: Column, decimals: bool) -> tuple[Column, Column]:
    """The number that a line begins with (null: none, or one of no value), and the trimmed rest of the line.

    Read from left to right: numerals; then, if a dash or a stroke follows with digits behind it,
    those as well, as the end of a range or as a divisor. decimals: see `correct` of parse_ingredient.
    """
    head, behind = _without(line, _NUMERALS)
    _, sign_on = _without(behind, _BLANKS)
    sign = F.left(sign_on, F.lit(1))
    second, after = _without(_without(F.substring(sign_on, F.lit(2), F.length(sign_on)), _BLANKS)[1], _DIGITS)
    two = (head != "") & sign.isin("-", "/") & (second != "")
    fraction = F.coalesce(*(F.when(F.contains(head, F.lit(c)), F.lit(v)) for c, v in FRACTIONS.items()))
    rest = F.when(two, after).otherwise(behind)
    if not decimals:
        return F.coalesce(fraction, F.when(~two, head.try_cast("double"))), F.trim(rest)
    whole = _without(head, _DIGITS)[0].try_cast("double")
    part, end = _without(F.substring(behind, F.lit(2), F.length(behind)), _DIGITS)
    point = whole.isNotNull() & fraction.isNull() & F.startswith(behind, F.lit(".")) & (part != "")
    ratio = F.when(two & (sign == "/"), F.try_divide(whole, second.try_cast("double")))
    plain = F.coalesce(ratio, F.coalesce(whole, F.lit(0.0)) + fraction, F.when(~two, whole))
    return F.when(point, F.concat(head, F.lit("."), part).try_cast("double")).otherwise(plain), F.trim(F.when(point, end).otherwise(rest))


def parse_ingredient(s: Column, mode: str = "faithful") -> Column:
    """struct<quantity, unit, item> of an ingredient line.

    faithful: a number with a vulgar fraction counts as the fraction, decimals lose their part
    behind the point, ranges and a/b have no quantity. correct: 1½ is 1.5, 1.5 is 1.5, 1/2 is 0.5.
    """
    line = F.trim(s)
    quantity, rest = _read_quantity(line, decimals=mode != "faithful")
    unit = F.nullif(F.lower(F.regexp_extract(line, _UNIT, 1)), F.lit(""))
    behind = F.when(unit.isNotNull() & rest.rlike(_UNIT), F.trim(F.regexp_extract(rest, r"(?is)\b(?:" + "|".join(UNITS) + r")\b(.*)$", 1))).otherwise(rest)
    item = F.nullif(F.initcap(F.trim(F.regexp_extract(behind, r"^([^,(]*)", 1))), F.lit(""))
    return F.when(item.isNotNull(), F.struct(quantity.alias("quantity"), unit.alias("unit"), item.alias("item")))


def parsed_lines(lines: DataFrame, text: str, mode: str = "faithful") -> DataFrame:
    """lines with quantity, unit and item instead of the text of an ingredient line; texts that occur often are parsed once."""
    from ladle.sources.scratch import written

    parsed = written(lines.select(text).distinct().withColumn("_p", parse_ingredient(F.col(text), mode)))  # a small table is broadcast
    return lines.join(parsed, lines[text].eqNullSafe(parsed[text]), "left").select(*(lines[c] for c in lines.columns if c != text), "_p.*")


def html_to_text(html: Column, most: int | None = None) -> Column:
    """Text without scripts, styles and tags; blank lines collapsed; all of it, or the first `most` characters."""
    s = html
    for tag in ("script", "style"):
        s = F.regexp_replace(s, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(s, "(?s)<[^>]*>", " "), r"\s+", " "))
    return text if most is None else F.substring(text, 1, most)


def strip_nul(s: Column) -> Column:
    return F.replace(s, F.lit("\x00"), F.lit(""))


def resolve_url(base: Column, link: Column) -> Column:
    """The absolute form of a link on a page."""
    scheme, host = F.regexp_extract(base, r"^([a-z]+)://", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"[^/]*$", "")
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), link))


def video_id(url: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([\w-]{11})", r"youtu\.be/([\w-]{11})", r"/(?:embed|shorts)/([\w-]{11})")))


def playlist_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]list=([\w-]+)", 1), F.lit(""))


def thumbnail_map(vid: Column) -> Column:
    sizes = {"default": "default", "medium": "mqdefault", "high": "hqdefault", "standard": "sddefault", "maxres": "maxresdefault"}
    return F.create_map(*(x for k, f in sizes.items() for x in (F.lit(k), F.concat(F.lit("https://img.youtube.com/vi/"), vid, F.lit(f"/{f}.jpg")))))


def split_ingredients(text: Column) -> Column:
    """A comma list; else lines without bullets and numbers; else the whole."""
    commas = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.when(text.contains(","), commas).when(text.contains("\n"), lines).otherwise(F.array(F.trim(text)))


def chunk_lines(text: Column, size: int = 50_000) -> Column:
    """Lines packed greedily into chunks of at most size characters (a longer line is a chunk)."""
    done = F.array().cast("array<string>")
    start = F.struct(done.alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, line: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(line) + 1 <= size
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), line.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), line).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), line.alias("open")))

    return F.aggregate(F.split(text, "\n"), start, add, lambda acc: F.array_append(acc["done"], acc["open"]))


def extract_json_block(text: Column) -> Column:
    """From the first [ to the last ]; else the text without code fences."""
    block = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(block != "", block).otherwise(F.trim(F.regexp_replace(text, r"```(?:json)?", "")))


def normalize_phone(p: Column, country: str = "+91") -> Column:
    bare = F.regexp_replace(p, r"[\s-]", "")
    return F.when(bare.startswith("+"), bare).when(bare.startswith(country[1:]) & (F.length(bare) == 12), F.concat(F.lit("+"), bare)).otherwise(F.concat(F.lit(country), F.ltrim(bare, F.lit("0"))))


def meal_from_hour(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return F.when((h >= 5) & (h < 11), "breakfast").when((h >= 11) & (h < 16), "lunch").when((h >= 16) & (h < 18), "snack").otherwise("dinner")


def season_from_month(m: Column) -> Column:
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "monsoon").otherwise("autumn")


def whole_days(since: Column, until: Column) -> Column:
    """Full days between two times, to the microsecond."""
    day = F.lit(86_400_000_000)
    micros = F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return ((micros - F.pmod(micros, day)) / day).cast("long")


def freshness_linear(days: Column) -> Column:
    return F.greatest(F.lit(0.5), 1 - days / 30 * 0.5)


def freshness_bucket(days: Column) -> Column:
    return F.when(days.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).otherwise(0.4)


def diversity_decay(days_since: Column, cooked_or_saved: Column, window: int = 14) -> Column:
    part = days_since / window
    return F.when(days_since.isNull() | (days_since >= window), 1.0).when(cooked_or_saved, F.greatest(F.lit(0.7), part)).otherwise(part)


def spice_match(recipe: Column, user: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(recipe - user) / 4.0)


def gravy_match(preference: Column, tags: Column) -> Column:
    return F.when(preference == "both", 1.0).when(F.array_contains(tags, preference), 1.0).when(F.arrays_overlap(tags, F.array(F.lit("gravy"), F.lit("dry"))), 0.3).otherwise(0.5)


def style_match(style: Column, tags: Column, wanted: Column) -> Column:
    return F.when(style == "balanced", 0.8).when(F.arrays_overlap(tags, wanted), 1.0).otherwise(0.3)


def affinity_seed(regions: Column, selected: Column, boundary: Column) -> Column:
    """region -> (affinity, confidence): selected .9/.95, accepted boundary .7/.6, else .3/.6."""
    return F.map_from_entries(F.transform(regions, lambda r: F.struct(r, F.when(F.array_contains(selected, r), F.struct(F.lit(0.9).alias("affinity"), F.lit(0.95).alias("confidence"))).when(boundary, F.struct(F.lit(0.7).alias("affinity"), F.lit(0.6).alias("confidence"))).otherwise(F.struct(F.lit(0.3).alias("affinity"), F.lit(0.6).alias("confidence"))))))
