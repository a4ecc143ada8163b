"""Personal data by weak supervision, in DataFrame operations only.

Fixed patterns propose candidate spans; regex, gazetteer, context and boundary labelers vote on each
(1 personal, -1 not, 0 abstains). Expectation-maximisation over the counts of vote patterns (a
bounded table) estimates how reliable each labeler is; its posteriors are the soft labels of a final
naive-Bayes span classifier over small categorical features, whose log-odds come from two more
aggregates. Base spans (e-mail, IP, card and phone by fixed rules) always stay; the classifier adds
national phone numbers, identity and account numbers, names after a title and secrets.

Null text counts as empty. Offsets are code points, end exclusive. Rows are independent, so repeated
rows repeat their result. An empty table gives an empty result. Added spans that overlap a base span
are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common

# --- fixed values: base patterns -----------------------------------------------------------------
# Possessive and anchored forms of the contract's patterns. They match the same strings: a run of
# local-part characters or digits can only match as a whole, so trying its inner starts is useless,
# and \G keeps a match that begins right behind the previous one.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# --- fixed values: patterns of the added kinds -----------------------------------------------------
ADDED = {
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "identity": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra|Sr)"
            r"\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key) ?[:=] ?[\"']?[a-z0-9_/+.-]{16,}+[\"']?",
}
KINDS = ("email", "ip", "card", "phone", "account", "identity", "name", "secret")
# What a text must hold before a pattern is tried on it.
GUARDS = {
    "email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]",
    "+phone": "[0-9]{3}[ .-][0-9]{4}", "+identity": "[0-9]-[0-9]{2}-[0-9]",
    "+name": "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra|Sr)\\.? ",
    "+secret": "(?i)(?:token|secret|passw|api[_-]?key) ?[:=]",
}
# --- fixed values: gazetteers and cue words ----------------------------------------------------------
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45",
                 "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "91")
CUES = (r"(?i)\b(?:e-?mails?|mail|contact|kontakt|contacto|call|phones?|tel|telefon|téléphone|teléfono|"
        r"mobile|fax|card|karte|carte|tarjeta|account|konto|compte|cuenta|iban|ssn|address|adresse|"
        r"server|host|ip|login|password|passwort|token|key|name|dear|cher|liebe|estimado)\b[^.\n]*$")
COUNTER_CUES = (r"(?i)(?:\b(?:version|v|release|page|seite|fig|figure|table|section|chapter|isbn|no|"
                r"total|sum|price|prix|preis|precio|build|revision)\b\.?:? ?|[$€£#=] ?)$")
CONTEXT = 48
VOTERS = ("regex", "gazetteer", "context", "boundary")


def _staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def candidates(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """``(row_id, doc_id, text)`` to one row per candidate; a text without any gives one null row.

    Columns: ``row_id, doc_id, source, kind, start, end, value, before, after``.
    """
    patterns = [("base", k, p, GUARDS[k]) for k, p in BASE.items()]
    patterns += [("added", k, p, GUARDS["+" + k]) for k, p in ADDED.items()]
    text = F.coalesce("text", F.lit(""))
    parts = {}
    for i, (_, _, pattern, guard) in enumerate(patterns):
        tried = F.rlike(text, F.lit(guard))
        parts[f"_m{i}"] = F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        parts[f"_g{i}"] = F.when(tried, F.split(text, pattern, -1))

    def listed(i: int, source: str, kind: str) -> Column:
        gaps = F.transform(
            F.col(f"_g{i}"),
            lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("r"),
                               F.left(g, F.lit(CONTEXT // 2)).alias("l")),
        )
        pairs = F.arrays_zip(
            gaps.alias("gap"), F.col(f"_m{i}").alias("value"),
            F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next"),
        )
        return F.transform(
            F.filter(pairs, lambda p: p["value"].isNotNull()),
            lambda p, at: F.struct(
                F.lit(source).alias("source"), F.lit(kind).alias("kind"), at.alias("at"),
                p["gap"]["n"].alias("gap"), p["value"].alias("value"), p["gap"]["r"].alias("before"),
                p["next"]["l"].alias("after"),
            ),
        )

    empty = F.expr("cast(array() as array<struct<source:string,kind:string,at:int,gap:int,"
                   "value:string,before:string,after:string>>)")
    arrays = [F.coalesce(listed(i, s, k), empty) for i, (s, k, _, _) in enumerate(patterns)]
    cut = _staged(docs.select("row_id", "doc_id", "text"), parts).drop("text")
    rows = cut.select("row_id", "doc_id", F.explode_outer(F.concat(*arrays)).alias("c")).select(
        "row_id", "doc_id", "c.*"
    )
    if by_text:
        # Copies of a text give the same matches, which are told apart by their place among its matches.
        rows = rows.distinct()
    length = F.length("value")
    order = W.partitionBy("row_id", "source", "kind").orderBy("at")
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        rows.repartition("row_id").withColumn("end", end.cast("long"))
        .withColumn("start", F.col("end") - length)
        .select("row_id", "doc_id", "source", "kind", "start", "end", "value", "before", "after")
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "(?<=.)(?=.)")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

    return F.aggregate(F.transform(backwards, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """The contract's checks on base matches."""
    digits = _digits(value)
    size = F.length(digits)
    octets = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(octets, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    card = F.when(size.between(16, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "phone", size.between(8, 15)).otherwise(False)
    )


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``is_base``, the four votes and the classifier's features.

    A digit run that is card-long but fails the check becomes an ``account`` candidate, against which the
    regex labeler votes; other failed base matches are dropped (their row stays as an empty one).
    """
    value, kind = F.col("value"), F.col("kind")
    base = (F.col("source") == "base") & is_valid(kind, value)
    digits = F.length(_digits(value))
    account = (F.col("source") == "base") & (kind == "card") & ~base & digits.between(16, 19)
    named = F.when(account, F.lit("account")).otherwise(kind)
    live = base | account | (F.col("source") == "added")
    staged = found.select(
        "row_id", "doc_id", "start", "end", "value", "before", "after",
        F.coalesce(base, F.lit(False)).alias("is_base"), F.when(live, named).alias("kind"),
    )
    compact, size = _digits(value), F.length(_digits(value))
    distinct = F.size(F.array_distinct(F.split(compact, "(?<=.)(?=.)")))
    top = F.lower(F.element_at(F.split(value, "\\."), -1))
    area = F.substring(compact, 1, 3)
    regex = (
        F.when(F.col("is_base"), 1)
        .when(kind == "account", -1)
        .when(kind == "identity", F.when(area.isin("000", "666") | area.startswith("9"), -1).otherwise(1))
        .when(kind == "secret", F.when(F.rlike(value, F.lit("[0-9]")), 1).otherwise(-1))
        .otherwise(0)
    )
    gazetteer = (
        F.when(kind == "email", F.when(top.isin(*TOP_DOMAINS), 1).otherwise(0))
        .when(kind == "ip", F.when(F.rlike(value, F.lit(r"^(?:0|127|255)\.")), -1).otherwise(1))
        .when(kind.isin("card", "account"),
              F.when(F.substring(compact, 1, 1).isin("3", "4", "5", "6"), 1).otherwise(-1))
        .when((kind == "phone") & F.col("is_base"),
              F.when(reduce(lambda a, b: a | b,
                            [F.substring(compact, 1, len(c)) == c for c in CALLING_CODES]), 1)
              .otherwise(-1))
        .when(kind == "name", 1)
        .otherwise(0)
    )
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    context = (
        F.when(F.rlike(before, F.lit(COUNTER_CUES)) & (kind != "secret"), -1)
        .when(F.rlike(before, F.lit(CUES)) | (kind == "secret"), 1).otherwise(0)
    )
    inside = F.rlike(before, F.lit(r"[\p{L}\p{N}_]$")) | F.rlike(after, F.lit(r"^[\p{L}\p{N}_]"))
    boundary = F.when(inside | ((size > 0) & (distinct <= 2) & (kind != "email")), -1).otherwise(1)
    voted = staged.select(
        "*", regex.alias("v_regex"), gazetteer.alias("v_gazetteer"), context.alias("v_context"),
        boundary.alias("v_boundary"),
    )
    features = {
        "f_kind": kind,
        "f_length": F.least(F.floor(F.length("value") / 4), F.lit(12)).cast("string"),
        "f_digits": F.least(size, F.lit(20)).cast("string"),
        "f_left": F.when(before == "", "edge").when(F.rlike(before, F.lit(r"\s$")), "space")
        .when(F.rlike(before, F.lit(r"[\p{L}\p{N}]$")), "word").otherwise("mark"),
        "f_right": F.when(after == "", "edge").when(F.rlike(after, F.lit(r"^\s")), "space")
        .when(F.rlike(after, F.lit(r"^[\p{L}\p{N}]")), "word").otherwise("mark"),
        "f_cue": F.col("v_context").cast("string"),
    }
    return _staged(voted, features)


FEATURES = ("f_kind", "f_length", "f_digits", "f_left", "f_right", "f_cue")


def estimate(patterns: list[dict], rounds: int = 40) -> dict:
    """Expectation-maximisation over counted vote patterns (at most kinds x 3^4 rows).

    Returns the posterior of every pattern and each labeler's estimated chance to be right when
    it votes. The start is the share of positive votes; classes have independent votes.
    """
    posterior = []
    for p in patterns:
        cast = [p[v] for v in VOTERS if p[v]]
        posterior.append((1 + sum(v > 0 for v in cast)) / (2 + len(cast)))
    for _ in range(rounds):
        weight = {c: 1.0 for c in (0, 1)}
        chance = {(v, x, c): 1.0 + (x == (1 if c else -1)) for v in VOTERS for x in (-1, 0, 1) for c in (0, 1)}
        for p, q in zip(patterns, posterior, strict=True):
            for c, share in ((1, q), (0, 1 - q)):
                weight[c] += p["n"] * share
                for v in VOTERS:
                    chance[v, p[v], c] += p["n"] * share
        for v in VOTERS:
            for c in (0, 1):
                total = sum(chance[v, x, c] for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    chance[v, x, c] /= total
        fresh = []
        for p in patterns:
            log = math.log(weight[1] / weight[0]) + sum(
                math.log(chance[v, p[v], 1] / chance[v, p[v], 0]) for v in VOTERS if p[v]
            )
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log)))))
        moved = max((abs(a - b) for a, b in zip(posterior, fresh, strict=True)), default=0.0)
        posterior = fresh
        if moved < 1e-9:
            break
    reliability = {}
    for v in VOTERS:
        right = sum(p["n"] * (q if p[v] > 0 else 1 - q)
                    for p, q in zip(patterns, posterior, strict=True) if p[v])
        cast = sum(p["n"] for p in patterns if p[v])
        reliability[v] = right / cast if cast else 0.5
    return {"posterior": posterior, "reliability": reliability}


def _lookup(pairs: dict[str, float], key: Column, default: float) -> Column:
    if not pairs:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def scored(found: DataFrame) -> DataFrame:
    """Judged, materialised candidates with the classifier's probability ``p``."""
    live = found.filter(F.col("kind").isNotNull())
    counted = live.groupBy("kind", *[f"v_{v}" for v in VOTERS]).agg(F.count(F.lit(1)).alias("n"))
    rows = [
        {"kind": r["kind"], "n": r["n"], **{v: r[f"v_{v}"] for v in VOTERS}}
        for r in counted.orderBy("kind", *[f"v_{v}" for v in VOTERS]).collect()
    ]
    fitted = estimate(rows)
    name = lambda r: "/".join([r["kind"], *[str(r[v]) for v in VOTERS]])
    soft = {name(r): q for r, q in zip(rows, fitted["posterior"], strict=True)}
    key = F.concat_ws("/", "kind", *[F.col(f"v_{v}").cast("string") for v in VOTERS])
    labelled = live.withColumn("q", _lookup(soft, key, 0.5))
    long = labelled.select(
        "q", F.explode(F.array(*[F.concat(F.lit(f + "="), F.col(f)) for f in FEATURES])).alias("f")
    )
    sums = long.groupBy("f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()
    yes, no = (sum(r[c] for r in sums) / len(FEATURES) for c in ("yes", "no"))
    width = {f: sum(r["f"].startswith(f + "=") for r in sums) for f in FEATURES}
    odds = {
        r["f"]: math.log((r["yes"] + 1) / (yes + width[r["f"].split("=")[0]]))
        - math.log((r["no"] + 1) / (no + width[r["f"].split("=")[0]]))
        for r in sums
    }
    prior = math.log((yes + 1) / (no + 1))
    logit = reduce(
        lambda a, b: a + b,
        [_lookup(odds, F.concat(F.lit(f + "="), F.col(f)), 0.0) for f in FEATURES], F.lit(prior),
    )
    return found.withColumn("p", F.when(F.col("kind").isNotNull(), 1 / (1 + F.exp(-logit))))


def spans(docs: DataFrame, minimum: float = 0.5, by_text: bool = False) -> DataFrame:
    """``(row_id, doc_id, text)`` to one row per document with its sorted ``spans``.

    With ``by_text`` the ``row_id`` names a text that several rows may hold; it counts once.
    ``spans`` is an array of ``(kind_no, start, end, kind, is_base, cut)``; ``cut`` is the greatest end of
    the spans that start before, 0 at first.
    """
    found = scored(cut_lineage(judged(candidates(docs, by_text))))
    rows = W.partitionBy("row_id").orderBy("start", "end", "kind")
    base_start = F.when(F.col("is_base"), F.col("start"))
    base_end = F.when(F.col("is_base"), F.col("end"))
    # Looking ahead is looking back in reverse order; a frame to the last row would be quadratic.
    reverse = W.partitionBy("row_id").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    ahead = F.min(base_start).over(reverse.rowsBetween(W.unboundedPreceding, 0))
    behind = F.max(base_end).over(rows.rowsBetween(W.unboundedPreceding, 0))
    overlaps = F.coalesce(ahead < F.col("end"), F.lit(False)) | F.coalesce(
        behind > F.col("start"), F.lit(False)
    )
    kept = F.col("is_base") | (~F.col("overlaps") & (F.col("p") >= minimum))
    kind_no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    before = F.max(F.when(F.col("kept"), F.col("end"))).over(rows.rowsBetween(W.unboundedPreceding, -1))
    span = F.struct(kind_no.alias("kind_no"), "start", "end", "kind", "is_base", "cut")
    return (
        found.withColumn("overlaps", overlaps).withColumn("kept", F.coalesce(kept, F.lit(False)))
        .withColumn("cut", F.coalesce(before, F.lit(0).cast("long")))
        .groupBy("row_id", "doc_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull() & F.col("kept"), span))).alias("spans"))
    )


def numbered(docs: DataFrame) -> DataFrame:
    """Rows numbered by their place in the scan, so that repeated and null ids stay apart."""
    return docs.withColumn("row_id", F.monotonically_increasing_id())


def _piece(chunks: Column, size: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` of a text that is cut into chunks of ``size``."""
    i, j = F.floor(begin / size).cast("int"), F.floor(end / size).cast("int")
    first = F.coalesce(F.get(chunks, i), F.lit(""))
    last = F.coalesce(F.get(chunks, j), F.lit(""))
    from_ = (begin - i * size + 1).cast("int")
    across = F.concat(
        F.substr(first, from_), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.substr(last, F.lit(1), (end - j * size).cast("int")),
    )
    return F.when(i == j, F.substr(first, from_, (end - begin).cast("int"))).otherwise(across)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``<KIND>`` and ``n_chars`` brought up to date.

    Spans and texts are read apart and meet by the digest of the text, which no other order or partitioning
    of the input changes; the spans of equal texts are found once. The text is cut into chunks once, so that a span costs a chunk's length and not the text's. All other
    columns, whatever their names, stay as they are.
    """
    digest = F.sha2("text", 256).alias("row_id")
    rows = docs.select(digest, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(common.DOC))
    texts = docs.filter("text is not null").select(digest, F.lit(None).cast("long").alias("doc_id"), "text")
    found = spans(texts, by_text=True).filter(F.size("spans") > 0)
    apart = F.filter("spans", lambda s: s["start"] >= s["cut"])
    cuts = F.array_sort(F.transform(apart, lambda s: F.struct(s["start"], s["cut"], s["kind"], s["end"])))
    tail = F.array_max(F.transform("spans", lambda s: s["end"]))
    joined = rows.join(
        found.select("row_id", cuts.alias("_cuts"), tail.alias("_tail")), "row_id", "left"
    ).withColumn("text", F.col(f"{common.DOC}.text"))
    length = F.length("text")
    size = F.greatest(F.lit(1024), (F.sqrt(length) * 16).cast("int"))
    begins = F.sequence(F.lit(0), F.floor(length / F.col("_size")).cast("int"))
    cut = joined.withColumn("_size", F.when(F.col("_cuts").isNotNull(), size)).withColumn(
        "_chunks", F.when(F.col("_cuts").isNotNull(), F.transform(
            begins, lambda i: F.substr(F.col("text"), i * F.col("_size") + 1, F.col("_size"))
        ))
    )
    chunks, width = F.col("_chunks"), F.col("_size")
    parts = F.transform("_cuts", lambda s: F.concat(
        _piece(chunks, width, s["cut"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")
    ))
    clean = F.concat(F.array_join(parts, ""), _piece(chunks, width, F.col("_tail"), length))
    out = cut.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(clean))
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(F.col("_cuts").isNotNull(), F.length("text").cast(kind)).otherwise(
            F.col(f"{common.DOC}.n_chars")
        )
    return out.select(*[fresh.get(c, F.col(f"{common.DOC}.`{c}`")).alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = spans(docs)

    def shown(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["is_base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )
