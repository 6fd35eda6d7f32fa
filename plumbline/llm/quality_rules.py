"""Quality rules by distribution divergence, in DataFrame and SQL functions alone.

A text's histogram of character classes and its histogram of common words (and of all others as one) are compared with
references of each language by Jensen-Shannon distance (base 2: 0 to 1). A text is kept if some language is near enough in
both; texts too short, by their own length, for a histogram to mean anything pass that histogram. Two plain rules (few words,
much repetition) come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, only

# Shares of character classes in running text, by language: a-z, A-Z, 0-9, white space, letters beyond ASCII, symbols #*$%&|<>, other.
CLASSES = ["a-z", "A-Z", "0-9", "\\x09-\\x0D\\x20", "\\x{80}-\\x{10FFFF}", "#*$%&|<>"]
CLASS_REFERENCES = {
    "en": [0.785, 0.022, 0.003, 0.165, 0.002, 0.001, 0.022],
    "fr": [0.735, 0.020, 0.003, 0.165, 0.052, 0.001, 0.024],
    "de": [0.775, 0.040, 0.003, 0.140, 0.020, 0.001, 0.021],
    "es": [0.760, 0.022, 0.003, 0.165, 0.028, 0.001, 0.021],
}
# The ten most common words of each language, and their shares of all words in running text: English after the
# counts of the Brown corpus, Spanish after those of the Academy's CREA, French and German rounded from public word lists.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se"],
}
WORD_SHARES = {
    "en": [0.0689, 0.0359, 0.0284, 0.0258, 0.0229, 0.0210, 0.0100, 0.0104, 0.0086, 0.0093],
    "fr": [0.0400, 0.0260, 0.0220, 0.0210, 0.0180, 0.0170, 0.0130, 0.0120, 0.0090, 0.0100],
    "de": [0.0340, 0.0320, 0.0250, 0.0180, 0.0120, 0.0110, 0.0100, 0.0100, 0.0090, 0.0070],
    "es": [0.0655, 0.0411, 0.0307, 0.0299, 0.0278, 0.0274, 0.0214, 0.0172, 0.0122, 0.0133],
}
#: The shares with that of all other words last.
WORD_REFERENCES = {lang: [*x, round(1 - sum(x), 4)] for lang, x in WORD_SHARES.items()}
#: Least characters and least words for the two histograms to count; largest distances kept. A text without any common word
#: lies some 0.3 from its language.
LEAST_CHARS, LEAST_WORDS, FAR_CLASSES, FAR_WORDS = 200, 100, 0.3, 0.26


def _array(values) -> str:
    return "array(" + ", ".join(f"{v!r}D" if isinstance(v, float) else str(v) for v in values) + ")"


def js_distance(counts: str, total: str, reference: list[float]) -> str:
    """SQL of the distance between an array of counts, whose sum ``total`` is over 0, and reference shares."""
    whole = sum(reference)
    part = "(CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0D END)"
    one = f"{part.format('p', 'q')} + {part.format('q', 'p')}"
    pairs = f"zip_with({counts}, {_array([r / whole for r in reference])}, (c, q) -> struct(c / {total} AS p, q AS q))"
    return f"sqrt(greatest(0D, aggregate(transform({pairs}, x -> {one.replace('p ', 'x.p ').replace('q ', 'x.q ').replace('p)', 'x.p)').replace('q)', 'x.q)')}), 0D, (s, x) -> s + x) / 2))"


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each text: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Words are runs of other than ASCII white space. ``n_repeat_words`` are words in 5-word windows that stand twice or more
    in the text; ``n_dup_lines`` are lines with a word that equal an earlier line. ``base_failed``: under 10 words, or over a
    fifth of the words repeated. Null and empty texts have no words and fail. Rows are judged alone, in the scan's own tasks;
    repeats and ties do no harm, other columns are not read, no rows give no rows.
    """
    t = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    in_list = ", ".join(f"'{w}'" for w in words)
    t = t.select(
        "doc_id", F.length("t").alias("chars"), F.expr(r"array_remove(split(t, '[\\x09-\\x0D\\x20]+'), '')").alias("ws"),
        F.expr(r"filter(split(t, '\\n'), x -> x RLIKE '[^\\x09-\\x0D\\x20]')").alias("lines"),
        *(F.length(F.regexp_replace("t", f"[^{c}]+", "")).alias(f"c{i}") for i, c in enumerate(CLASSES)),
    )
    t = t.withColumns({
        "n_words": F.size("ws").cast("long"), "word_chars": (F.col("chars") - F.col("c3")).cast("long"), "n_symbols": F.col("c5").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "runs": F.expr("CASE WHEN size(ws) < 6 THEN array() ELSE transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) END"),
        "common": F.expr(f"filter(transform(ws, x -> lower(x)), x -> x IN ({in_list}))"),
    }).drop("lines")
    # Windows by content, then place; only texts with some window twice are sorted.
    t = t.withColumn("placed", F.expr("CASE WHEN size(runs) = size(array_distinct(runs)) THEN array() ELSE sort_array(transform(runs, (h, i) -> struct(h AS h, i AS i))) END")).drop("runs", "ws")
    t = t.withColumn("twice", F.expr("sort_array(transform(filter(transform(placed, (x, j) -> struct(x.i AS i, (j > 0 AND placed[greatest(j - 1, 0)].h = x.h) OR (j < size(placed) - 1 AND placed[least(j + 1, size(placed) - 1)].h = x.h) AS again)), x -> x.again), x -> x.i))")).drop("placed")
    t = t.withColumn("n_repeat_words", F.expr("CAST(aggregate(twice, struct(0 AS n, 0 AS reach), (s, i) -> struct(s.n + i + 5 - greatest(i, s.reach) AS n, i + 5 AS reach), s -> s.n) AS BIGINT)")).drop("twice")
    t = t.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    rest = " - ".join(["chars", *(f"c{i}" for i in range(len(CLASSES)))])
    t = t.withColumn("classes", F.expr(f"transform(array({', '.join(f'c{i}' for i in range(len(CLASSES)))}, {rest}), x -> CAST(x AS DOUBLE))"))
    # One string with a space of its own on either side of each word: what is lost with a word's removal tells how often it stands there.
    t = t.withColumn("joined", F.expr("concat(' ', array_join(common, '  '), ' ')")).drop("common")
    t = t.withColumns({f"w_{w}": F.expr(f"CAST((octet_length(joined) - octet_length(replace(joined, ' {w} ', ''))) DIV {len(w) + 2} AS DOUBLE)") for w in words}).drop("joined")
    for lang, ws in COMMON_WORDS.items():
        t = t.withColumn(f"words_{lang}", F.expr(f"array({', '.join(f'w_{w}' for w in ws)}, n_words - ({' + '.join(f'w_{w}' for w in ws)}))"))
    near = " OR ".join(
        f"((chars < {LEAST_CHARS} OR {js_distance('classes', 'greatest(chars, 1)', CLASS_REFERENCES[lang])} <= {FAR_CLASSES}D) AND (n_words < {LEAST_WORDS} OR {js_distance(f'words_{lang}', 'greatest(n_words, 1L)', WORD_REFERENCES[lang])} <= {FAR_WORDS}D))"
        for lang in COMMON_WORDS
    )
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"NOT base_failed AND ({near})").alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents; a null text is an empty one."""
    return quality_rules(documents(spark, sf_dir))


def _duck(counts: list[str], total: str, reference: list[float]) -> str:
    whole = sum(reference)
    part = "(CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END)"
    terms = [f"{part.format(p, q)} + {part.format(q, p)}" for c, r in zip(counts, reference, strict=True) for p, q in [(f"({c}::DOUBLE / {total})", repr(r / whole) + "::DOUBLE")]]
    return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"


def _sql() -> str:
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    classes = [f"c{i}" for i in range(len(CLASSES))] + ["(chars - " + " - ".join(f"c{i}" for i in range(len(CLASSES))) + ")"]
    bins = {lang: [*(f"w_{w}" for w in ws), "(n_words - (" + " + ".join(f"w_{w}" for w in ws) + "))"] for lang, ws in COMMON_WORDS.items()}
    near = " OR ".join(
        f"((chars < {LEAST_CHARS} OR {_duck(classes, 'chars', CLASS_REFERENCES[lang])} <= {FAR_CLASSES}) AND (n_words < {LEAST_WORDS} OR {_duck(bins[lang], 'n_words', WORD_REFERENCES[lang])} <= {FAR_WORDS}))"
        for lang in COMMON_WORDS
    )
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, length(t) AS chars, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  {', '.join(f"length(regexp_replace(t, '[^{c}]+', '', 'g')) AS c{i}" for i, c in enumerate(CLASSES))} FROM t),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM a),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS k FROM p WHERE i + 4 <= len(ws)),
f AS (SELECT p.doc_id, max(CASE WHEN v.k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM p LEFT JOIN v ON v.doc_id = p.doc_id AND v.i = p.i),
r AS (SELECT doc_id, sum(again)::BIGINT AS n_repeat_words FROM f GROUP BY doc_id),
w AS (SELECT doc_id, {', '.join(f"count(*) FILTER (x = '{w}') AS w_{w}" for w in words)} FROM (SELECT doc_id, lower(unnest(ws)) AS x FROM a) GROUP BY doc_id),
b AS (SELECT a.*, len(ws)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {', '.join(f"coalesce(w_{w}, 0) AS w_{w}" for w in words)} FROM a LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id)),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, (chars - c3)::BIGINT AS word_chars, c5::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({near}) AS kept
FROM c
"""


OP10_SQL = _sql()
