"""Scalar text functions as Column builders; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K

# Unicode white space plus the four ASCII separators that the corpus tools also treat as space.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$|^{SPACE}+", "")


def collapse_spaces(text: Column) -> Column:
    """Trim and reduce every run of white space to one space."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def normalize_status(raw: Column) -> Column:
    key = F.lower(collapse_spaces(F.coalesce(raw, F.lit(""))))
    return F.coalesce(_literal_map(K.STATUS_ALIASES)[key], F.lit(K.UNKNOWN_STATUS))


def split_multi_value(raw: Column) -> Column:
    # The separators take the white space around them along, so that no part has to be stripped by itself.
    around = r"[\s\x1c-\x1f]*"
    parts = F.split(strip(F.coalesce(raw, F.lit(""))), rf"(?U){around}[,;\n]+{around}")
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != "-")))


def split_organization_sources(raw: Column) -> Column:
    """Names of a free-text source field; a trailing corporate suffix joins the name before it."""
    listed = F.regexp_replace(F.coalesce(raw, F.lit("")), "[•·?]+", ",")
    without_role = F.transform(
        F.split(listed, r"[,;\n]+"),
        lambda p: F.btrim(
            F.regexp_replace(p, r"(?i)\s*\(pen[- ]holder\)\s*", ""), F.lit(" []()\t\n.")
        ),
    )
    names = F.filter(without_role, lambda p: (p != "") & (p != "-"))

    def is_suffix(name: Column) -> Column:
        return F.lower(name).isin(*K.CORPORATE_SUFFIXES)

    def glue(seen: Column, name: Column) -> Column:
        head = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        joined = F.concat(F.element_at(seen, -1), F.lit(", "), name)
        return F.when(is_suffix(name) & (F.size(seen) > 0), F.concat(head, F.array(joined))).otherwise(
            F.concat(seen, F.array(name))
        )

    def glued(listed: Column) -> Column:
        return F.aggregate(listed, F.expr("CAST(array() AS array<string>)"), glue)

    # The array binds the names, so that they are computed once; few fields hold a suffix at all.
    bound = F.transform(
        F.array(names), lambda n: F.when(F.exists(n, is_suffix), glued(n)).otherwise(n)
    )
    return F.array_distinct(bound[0])


def normalize_column(raw: Column) -> Column:
    key = F.regexp_replace(F.lower(strip(raw)), r"[^a-z0-9]+", "_")
    return F.btrim(F.coalesce(_literal_map(K.COLUMN_ALIASES)[key], key), F.lit("_"))


def alias_pairs(aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Lower-cased alias -> canonical name; one alias naming two canonicals is an error."""
    pairs: dict[str, str] = {}
    for canonical, names in (K.ORGANIZATION_ALIASES if aliases is None else aliases).items():
        for name in (canonical, *names):
            key = name.strip().casefold()
            if pairs.setdefault(key, canonical) != canonical:
                raise ValueError(f"organisation alias {name!r} is ambiguous")
    return pairs


def _tidy_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, rf"{SPACE}+", " "), F.lit(" ,;\t\n"))


def _canonical_name(tidy: Column, pairs: dict[str, str]) -> Column:
    return F.coalesce(_literal_map(pairs)[F.lower(tidy)], tidy) if pairs else tidy


def normalize_organization(name: Column, aliases: dict[str, str] | None = None) -> Column:
    return _canonical_name(_tidy_name(name), alias_pairs() if aliases is None else aliases)


def organizations(source: Column, aliases: dict[str, str] | None = None) -> Column:
    """Ordered canonical organisation names of a source field."""
    pairs = alias_pairs() if aliases is None else aliases
    tidy = F.transform(split_organization_sources(source), _tidy_name)
    return F.transform(tidy, lambda n: _canonical_name(n, pairs))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases of an ``(alias, canonical)`` table that name more than one organisation."""
    return (
        aliases.groupBy(F.lower(strip(F.col("alias"))).alias("alias"))
        .agg(F.count_distinct("canonical").alias("canonicals")).filter(F.col("canonicals") > 1)
    )


def with_canonical_names(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``canonical`` from an alias table; names without an alias stay as they are."""
    tidy = F.btrim(F.regexp_replace(F.col(column), rf"{SPACE}+", " "), F.lit(" ,;\t\n"))
    known = aliases.select(F.lower(strip(F.col("alias"))).alias("_alias"), "canonical")
    return (
        rows.withColumn("_tidy", tidy).join(known, F.lower("_tidy") == F.col("_alias"), "left")
        .withColumn("canonical", F.coalesce("canonical", "_tidy")).drop("_tidy", "_alias")
    )


def canonical_identifier(value: Column) -> Column:
    """Lower-cased words joined by dashes; above 80 characters a prefix and the hash of the whole."""
    spaced = F.btrim(F.regexp_replace(F.lower(value), r"(?U)[\s\x1c-\x1f/]+", " "), F.lit(" "))
    slug = F.replace(spaced, F.lit(" "), F.lit("-"))
    short = F.concat(F.substring(slug, 1, 63), F.lit("-"), F.substring(F.sha2(slug, 256), 1, 16))
    # No text has more characters than bytes, in lower case either, so most values need no second look.
    return F.when((F.octet_length(value) <= 80) | (F.length(slug) <= 80), slug).otherwise(short)


def typed_id(entity_type: Column | str, identifier: Column) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.concat(kind, F.lit(":"), identifier)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), F.lit(0))


def tokens_of_words(n: Column) -> Column:
    """Token estimate of a text with ``n`` words."""
    return F.when(n > 0, F.greatest(F.lit(1), (n * F.lit(1.3)).cast("int"))).otherwise(F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def max_words(max_tokens: int) -> int:
    return max(1, int(max_tokens / 1.3))


def word_windows(text: Column, size: int) -> Column:
    """The words of ``text`` in consecutive windows of ``size``, each joined by one space."""
    all_words = words(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(all_words), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.array_join(F.slice(all_words, s, F.lit(size)), " "))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.NUMBER_PATTERN), F.lit(0))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors; unequal or empty dimensions are an error, a zero norm gives 0."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(left, right) / norm)
    bad = (F.size(left) != F.size(right)) | (F.size(left) == 0)
    return F.when(
        bad, F.raise_error(F.lit("vectors must have the same non-zero dimensions")).cast("double")
    ).otherwise(value)


def lexical_score(query: Column, text: Column) -> Column:
    """Score of one query against one text, for row-wise use; bulk scoring is in ``operators.retrieval``."""
    wanted = F.array_distinct(tokenize(query))
    found = tokenize(text)
    hits = F.transform(
        wanted, lambda q: F.least(F.size(F.filter(found, lambda t: t == q)), F.lit(3))
    )
    matched = F.aggregate(hits, F.lit(0), lambda acc, h: acc + h)
    coverage = F.size(F.filter(hits, lambda h: h > 0)) / F.size(wanted)
    phrase = F.when(F.contains(F.lower(text), F.lower(strip(query))), 1.0).otherwise(0.0)
    return F.when((F.size(wanted) == 0) | (F.size(found) == 0), F.lit(0.0)).otherwise(
        matched + coverage + phrase
    )


def _float_text(value: Column) -> Column:
    """Shortest text of a float: whole values as digits, others with a two-digit exponent if any."""
    plain = value.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.replace(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    sign = F.when(F.startswith(plain, F.lit("-")), "-").otherwise("")
    # From 1e-4 on, a negative exponent is written out with leading zeros.
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    with_exponent = F.when(exponent >= -4, small).otherwise(scientific)
    # A whole value below 2^63 is written as an integer; above, its exact digits fit a wide decimal.
    whole = F.when(F.abs(value) < 9.2e18, value.cast("decimal(38,0)").cast("string")).otherwise(
        F.coalesce(value.try_cast("decimal(38,0)").cast("string"), plain)
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(F.rint(value) == value, whole)
        .when(F.contains(plain, F.lit("E-")), with_exponent)
        .when(F.contains(plain, F.lit("E")), 
              F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", ""))
        .otherwise(plain)
    )


def cell_text(cell: Column, kind: str) -> Column:
    """Spreadsheet cell to text for a cell of Spark type name ``kind``."""
    if kind == "boolean":
        text = F.when(cell, "TRUE").otherwise("FALSE")
    elif kind in ("double", "float"):
        text = _float_text(cell.cast("double"))
    elif kind == "date":
        text = F.date_format(cell, "yyyy-MM-dd")
    elif kind == "timestamp":
        seconds = F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(cell, "SSSSSS")
        text = F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
    else:
        text = strip(cell.cast("string"))
    return F.when(cell.isNull(), "").otherwise(text)


def optional_text(value: Column) -> Column:
    text = strip(value)
    return F.when((text == "") | (text == "-"), None).otherwise(text)


def looks_like_document_id(value: Column) -> Column:
    compact = F.replace(F.upper(value), F.lit(" "), F.lit(""))
    prefixed = F.lit(False)
    for prefix in K.DOCUMENT_ID_PREFIXES:
        prefixed = prefixed | F.startswith(compact, F.lit(prefix))
    return prefixed & F.rlike(compact, F.lit(r"\d"))


def natural_key(value: Column) -> Column:
    """Array key that sorts digit runs by number and everything else by lower-cased text."""
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"\d+|\D+"), F.lit(0))

    def keyed(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        size = F.lpad(F.length(digits).cast("string"), 8, "0")
        return F.when(F.rlike(part, F.lit(r"^\d")), F.concat(size, digits)).otherwise(part)

    key = F.transform(parts, keyed)
    return F.when(F.rlike(value, F.lit(r"^\d")), F.concat(F.array(F.lit("")), key)).otherwise(key)


def meeting_number(meeting_id: Column) -> Column:
    ok = F.rlike(meeting_id, F.lit(K.MEETING_ID_PATTERN))
    message = F.concat(F.lit("invalid canonical meeting identifier: "), meeting_id)
    return F.when(
        ok, F.regexp_extract(meeting_id, K.MEETING_ID_PATTERN, 1).cast("int")
    ).otherwise(F.raise_error(message).cast("int"))


def meeting_variant(meeting_id: Column) -> Column:
    return F.lower(F.regexp_extract(meeting_id, K.MEETING_ID_PATTERN, 2))


def normalize_variant(raw: Column) -> Column:
    tidy = F.lower(F.btrim(F.coalesce(raw, F.lit("")), F.lit("_- ")))
    return F.when(tidy.isin("ahe", "ah-e"), "ah-e").otherwise(tidy)


def stem(filename: Column) -> Column:
    """File name without folders and without its last suffix."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def document_id_of(filename: Column) -> Column:
    return F.upper(stem(filename))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(?<=[^/])(\.[^./]*)$", 1))


def is_draft(filename: Column) -> Column:
    name = F.lower(filename)
    return F.contains(name, F.lit("draft")) | F.contains(name, F.lit("skeleton"))


def report_authority(filename: Column) -> Column:
    return (
        F.when(F.contains(F.lower(filename), F.lit("approved")), "approved_report")
        .when(is_draft(filename), "draft_report")
        .otherwise("final_report")
    )


def authority_weight(authority: Column) -> Column:
    pairs = [F.lit(x) for k, v in K.AUTHORITY_RANK.items() for x in (k, v / 100)]
    return F.create_map(*pairs)[authority]


def extraction_method(filename: Column) -> Column:
    return F.concat(F.lower(F.element_at(F.split(filename, r"\."), -1)), F.lit("_section_block"))


def row_evidence_text(*parts: Column) -> Column:
    """The whole text behind a row's evidence."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " | ")


def excerpt(body: Column, chars: int = K.EXCERPT_CHARS) -> Column:
    """What a listing shows of a text: its first ``chars`` code points. The text stays beside it."""
    return F.substring(body, 1, chars)


def paragraph_kind(text: Column, style: Column) -> Column:
    look = F.lower(F.coalesce(style, F.lit("")))
    low = F.lower(text)
    return (
        F.when(F.contains(look, F.lit("heading")) | look.isin("title", "doc-title"), "heading")
        .when(F.startswith(look, F.lit("list")), "list_item")
        .when(F.startswith(low, F.lit("discussion:")) | (look == "comments"), "discussion")
        .when(F.startswith(low, F.lit("agreement:")) | (look == "agreement"), "agreement")
        .when(F.startswith(low, F.lit("conclusion:")), "conclusion")
        .when(F.startswith(low, F.lit("note:")), "note")
        .otherwise("paragraph")
    )


def heading_level(style: Column) -> Column:
    """The last word of the style that is all digits, at least 1."""
    numbers = F.filter(F.split(style, r"\s+"), lambda w: F.rlike(w, F.lit(r"^\d+$")))
    last = F.try_element_at(numbers, F.lit(-1)).try_cast("int")
    return F.greatest(F.lit(1), F.coalesce(last, F.lit(1)))


def group_type(kind: Column) -> Column:
    return (
        F.when(kind == "table_row", "table")
        .when(kind.isin("discussion", "agreement", "conclusion", "note"), kind)
        .otherwise("body")
    )


def page_number(title: Column) -> Column:
    return F.regexp_extract(title, K.PAGE_TITLE_PATTERN, 1).try_cast("int")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), numerator / denominator)
    )


def vector_is_valid(vector: Column, dimensions: int | None = None) -> Column:
    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    sized = F.lit(True) if dimensions is None else F.size(vector) == dimensions
    return F.coalesce(vector.isNotNull() & sized & finite, F.lit(False))


def list_contains_text(values: Column, needle: str) -> Column:
    """Case-insensitive substring test over the members of a list column."""
    return F.coalesce(
        F.exists(values, lambda v: F.contains(F.lower(v), F.lit(needle.lower()))), F.lit(False)
    )
