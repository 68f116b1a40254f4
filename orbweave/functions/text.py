"""Text, identifier, hash and JSON expressions (labels, slugs, tokens, keys, colours)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s ]+"


def normalize_label(c: Column) -> Column:
    """Lower case, underscores as blanks, white space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))), r"\s+", " "))


def slug(c: Column) -> Column:
    """A label as a file-safe name; 'object' when nothing is left."""
    s = F.regexp_replace(normalize_label(c), r"[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit("")), F.lit("object"))


def normalize_token(c: Column, upper: bool = False) -> Column:
    """Words joined by underscores, camel case split; null when nothing is left.

    Compatibility forms (full-width letters and the like) must be normalised beforehand; see
    :func:`orbweave.operators.models.nfkc`.
    """
    t = F.regexp_replace(F.trim(c), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"_+", "_"), r"^_|_$", "")
    return F.nullif(F.upper(t) if upper else F.lower(t), F.lit(""))


def normalize_tokens(c: Column, upper: bool = False) -> Column:
    """Tokens of an array, empty ones dropped, first occurrences kept in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: normalize_token(x, upper)), lambda x: x.isNotNull()))


def json_object_text(c: Column) -> Column:
    """The text from the first opening to the last closing brace, code fences or prose around it dropped; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def has_exact_keys(c: Column, keys: list[str]) -> Column:
    """Whether a JSON object text has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(c)) == F.array(*(F.lit(k) for k in sorted(keys))), F.lit(False))


def canonical_json(*cols: str) -> Column:
    """Compact JSON of the columns in order of their names, nulls included."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"})


def canonical_hash(*cols: str) -> Column:
    return F.sha2(canonical_json(*cols), 256)


def stable_color(c: Column) -> Column:
    """Three channels in [0.2, 0.95] from the first bytes of the SHA-256 of a text."""
    h = F.sha2(c, 256)
    return F.array(*(F.lit(0.2) + F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255 * 0.75 for i in (1, 3, 5)))


def first_nonempty(*cols: Column) -> Column:
    """The first text that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols))


def lineage(c: Column, default: Column | None = None) -> Column:
    """Trimmed, non-empty, distinct texts of an array in order; the default where it is null."""
    c = F.coalesce(c, default) if default is not None else c
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def object_key(tag: Column, ident: Column) -> Column:
    """``tag_id``; null for failed or invalid tags."""
    bad = F.lower(F.trim(tag)).isin("fail", "invalid")
    return F.when(~bad, F.concat_ws("_", normalize_token(tag), ident.cast("string")))


def cache_filename(index: Column, ident: Column) -> Column:
    """Six digits of the index and the first 16 hexadecimal digits of the id's hash."""
    return F.concat(F.lpad(index.cast("string"), 6, "0"), F.lit("_"), F.substring(F.sha2(ident.cast("string"), 256), 1, 16), F.lit(".json"))


def detection_id(frame: Column, index: Column) -> Column:
    return F.concat(frame, F.lit(":"), F.lpad(index.cast("string"), 6, "0"))


def prompt_id(label: Column, frame: Column, index: Column) -> Column:
    return F.concat(F.lit("cg_"), slug(label), F.lit("_f"), frame, F.lit("_d"), index.cast("string"))


def is_safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False))


def clean_caption(c: Column) -> Column:
    """White space collapsed, a leading ``caption:`` and quotes around it dropped."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    t = F.trim(F.regexp_replace(t, r"(?i)^caption\s*:\s*", ""))
    return F.regexp_replace(t, "^[\"']+|[\"']+$", "")


def is_low_confidence(c: Column, marker: str) -> Column:
    return F.coalesce(F.lower(c).contains(marker.lower()), F.lit(False))


def tag_classes(c: Column, add: list[str] = [], remove: list[str] = []) -> Column:  # noqa: B006
    """Comma-separated tags as classes: trimmed, non-empty, then ``add`` where missing, without those that contain a ``remove`` term."""
    out = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    for a in add:
        out = F.when(F.array_contains(out, a), out).otherwise(F.concat(out, F.array(F.lit(a))))
    for term in remove:
        out = _without(out, term)
    return out


def _without(c: Column, term: str) -> Column:
    return F.filter(c, lambda x: ~F.lower(x).contains(term))


def camel_words(c: Column) -> Column:
    """``CoffeeTable`` as ``coffee table``."""
    return F.lower(F.array_join(F.regexp_extract_all(c, F.lit("([A-Z][^A-Z]*)"), F.lit(1)), " "))


def category(c: Column, terms: tuple[str, ...] = ("wall", "floor", "ceiling", "door", "window")) -> Column:
    low = F.lower(c)
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t)
    return F.when(hit, "structure").otherwise("object")


def path_remap(c: Column, old: str, new: str, existing: Column) -> Column:
    """The path with its prefix exchanged, if the exchanged path exists."""
    moved = F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))
    return F.when(c.startswith(old) & F.array_contains(existing, moved), moved).otherwise(c)


def run_id() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def round_all(c: Column, digits: int) -> Column:
    """Half-even rounding of every element, as numeric Python rounds."""
    return F.transform(c, lambda x: F.bround(x, digits))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def scan_tag(c: Column) -> Column:
    """The object tag of a reply that is not quite JSON: the first quoted text after the key."""
    return F.nullif(F.regexp_extract(c, r"(?is)[\"']?object_tag[\"']?\s*:\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def report_path(c: Column, ending: str = "_conversion_report.json") -> Column:
    """The report's path beside a file: its suffixes exchanged for ``ending``."""
    return F.concat(F.regexp_replace(c, r"(\.[A-Za-z]+)+$", ""), F.lit(ending))


def merge_maps(base: Column, over: Column) -> Column:
    """Entries of ``over`` laid on ``base``; a null entry of ``over`` changes nothing."""
    return F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))
