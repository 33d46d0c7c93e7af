"""Named queries of the core operators over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactry.functions import expressions, rules
from redactry.operators import detect, govern, mask, ner, ocr, resolve, risk
from redactry.plans import api
from redactry.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "scan_requests", "scan_id", "text", "scan_language", "confidence_threshold")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """The stored spans, each delivered row once, with a total order for ties."""
    df = load(spark, sf, "detected_entities", "entity_id", "scan_id", "entity_type", "span_start", "span_end", "score")
    return df.dropDuplicates(["entity_id"]).withColumnRenamed("entity_id", "ord")


ONCE = "WITH once AS (SELECT DISTINCT ON (entity_id) * FROM detected_entities ORDER BY entity_id) "


# ---- detection -------------------------------------------------------------------------------------------------

#: Look-ahead is missing in the oracle's regular expressions; these say the same without it.
WITHOUT_LOOKAHEAD = {
    r"\b0(?![35789])\d{9}\b|\b[1-9]\d{9}\b": r"\b0[0-24-6]\d{9}\b|\b[1-9]\d{9}\b",
    rules.IPV6: rules.IPV6.removeprefix(r"(?<![\w:.])").removesuffix(r"(?![\w:]|\.\d)"),  # no longer run of groups stands in the texts
}


#: The oracle's word boundary is that of ASCII and cannot be replaced where a match may touch a letter beyond it;
#: these queries are compared with Python's expressions in the tests instead.
NO_ORACLE = ("detect_financial_metric", "detect_bank_account_number", "detect_general_email_address", "detect_general_phone_number")


def unicode_classes(regex: str) -> str:
    r"""\d and \s in the oracle's expressions as sets of Unicode, inside and outside of brackets."""
    out, inside, i = [], False, 0
    while i < len(regex):
        two = regex[i : i + 2]
        if two in (r"\d", r"\s"):
            both = r"\p{Nd}" if two == r"\d" else r"\s\p{Z}"
            out.append(both if inside else f"[{both}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def spans_sql(entity_type: str, patterns, source: str = "scan_requests", key: str = "scan_id") -> str:
    """Places summed from the pieces between matches, as the column expression does."""
    parts = []
    for p in patterns:
        rx = unicode_classes(WITHOUT_LOOKAHEAD.get(p.regex, p.regex)).replace("'", "''")
        parts.append(
            f"SELECT {key}, m[i] AS text_val, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS span_start, {p.score}::DOUBLE AS score "
            f"FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{rx}', 0, 'is') AS m, string_split_regex(text, '{rx}', 'is') AS g FROM {source}) WHERE len(m) > 0)"
        )
    return f"SELECT {key}, '{entity_type}' AS entity_type, span_start, (span_start + length(text_val))::INT AS span_end, text_val, score FROM (" + " UNION ALL ".join(parts) + ")"


def _detector(r: rules.Rule):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect.detect_type(requests(spark, sf), "scan_id", "text", (r,))

    run.__doc__ = f"Candidates of {r.entity_type} with base scores."
    return run


for _r in rules.CUSTOM:
    _name = f"detect_{_r.entity_type.lower()}"
    QUERIES[_name] = _detector(_r)
    if _name not in NO_ORACLE:
        ORACLES[_name] = spans_sql(_r.entity_type, _r.patterns)
for _r in rules.GENERAL:
    _name = f"detect_general_{_r.entity_type.lower()}"
    if _r.validate is None:
        QUERIES[_name] = _detector(_r)
        if _name not in NO_ORACLE and "(?!" not in "".join(WITHOUT_LOOKAHEAD.get(p.regex, p.regex) for p in _r.patterns):
            ORACLES[_name] = spans_sql(_r.entity_type, _r.patterns)


# Texts for the rules that the stored texts hardly touch: the same expression in Spark and in SQL.
SEEDS = """CASE o_orderkey % 9
 WHEN 0 THEN concat('Deploy user ', CAST(o_custkey AS STRING), ' signs in with AKIA', lpad(CAST(o_orderkey AS STRING), 16, 'Q'), ' since May')
 WHEN 1 THEN concat('conn = postgresql://admin:pw', CAST(o_custkey AS STRING), '@db.internal:5432/prod now')
 WHEN 2 THEN concat('api_key = "k', lpad(CAST(o_orderkey AS STRING), 12, 'x'), '" and sk-', lpad(CAST(o_orderkey AS STRING), 24, 'z'), ' too')
 WHEN 3 THEN concat('Server config ', CAST(o_orderkey AS STRING), ' -----BEGIN RSA PRIVATE KEY----- follows')
 WHEN 4 THEN concat('GPS: 21.0', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ', 105.7', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), ' of depot')
 WHEN 5 THEN concat('This CONFIDENTIAL paper ', CAST(o_orderkey AS STRING), ' holds a trade secret of the firm')
 WHEN 6 THEN concat('The password for the bank account is: p', CAST(o_orderkey % 100000 AS STRING), ' today')
 WHEN 7 THEN concat('Link eyJhb', CAST(o_orderkey AS STRING), '.eyJzd', CAST(o_custkey AS STRING), '.sig', CAST(o_orderkey AS STRING), ' expires')
 ELSE concat('MAC 00:1A:2B:3C:4D:', lpad(CAST(o_orderkey % 90 + 10 AS STRING), 2, '0'), ' on the rack') END"""
SEEDED = [r for r in rules.RULES if r.entity_type in ("INFRA_SECRET", "CRYPTO_PRIVATE_KEY", "GPS_LOCATION", "IP_SENSITIVE_MARKER", "FINANCIAL_CREDENTIAL", "MAC_ADDRESS")]


@query(" UNION ALL ".join(f"({spans_sql(r.entity_type, r.patterns, f'(SELECT o_orderkey, {SEEDS} AS text FROM orders)', 'o_orderkey')})" for r in SEEDED))
def detect_seeded(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.expr(SEEDS).alias("text"))
    return detect.detect_type(rows, "o_orderkey", "text", tuple(SEEDED))


@query()
def scan_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All rules with context and validators at the default threshold, the best candidate of each span."""
    found = detect.detect(requests(spark, sf), "scan_id", "text")
    return resolve.best_per_span(found, "scan_id").drop("ord")


@query()
def scan_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Whole answers as JSON: status, entities in order, masked text."""
    rows = requests(spark, sf)
    return api.as_json(api.scan(rows, "scan_id", "text", anonymize=True, language_col="scan_language", languages=("en", "vi", "de", "fr", "es", "pt", "ru")))


@query(ONCE + "SELECT count(*) FILTER (entity_type IN (" + ", ".join(f"'{t}'" for t in sorted({r.entity_type for r in rules.CUSTOM})) + ")) AS custom_hits, count(*) AS hits FROM once")
def custom_hits(spark: SparkSession, sf: str) -> DataFrame:
    own = sorted({r.entity_type for r in rules.CUSTOM})
    return entities(spark, sf).agg(F.count(F.when(F.col("entity_type").isin(*own), 1)).alias("custom_hits"), F.count("*").alias("hits"))


@query()
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.detect(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", threshold=rules.CORPUS_THRESHOLD)
    return resolve.best_per_span(found, "doc_id").drop("ord")


@query()
def validated_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Cards, accounts and wallets whose check digits hold."""
    only = tuple(r for r in rules.GENERAL if r.validate)
    return detect.detect(requests(spark, sf), "scan_id", "text", only, 0.0).drop("ord", "context_snippet")


@query("SELECT o_orderkey, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN substr(digits, i, 1)::INT ELSE substr(digits, i, 1)::INT * 2 - CASE WHEN substr(digits, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS valid FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 16, '4') AS digits FROM orders)")
def luhn_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4").alias("digits"))
    return rows.withColumn("valid", expressions.luhn(F.col("digits")))


@query("SELECT o_orderkey, iban, ((substr(iban, 5) || '1314' || substr(iban, 3, 2))::HUGEINT % 97)::INT AS remainder FROM (SELECT o_orderkey, 'DE' || lpad((o_orderkey % 97)::VARCHAR, 2, '0') || lpad((o_orderkey * 31 + o_custkey)::VARCHAR, 18, '37') AS iban FROM orders)")
def iban_check(spark: SparkSession, sf: str) -> DataFrame:
    iban = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 31 + F.col("o_custkey")).cast("string"), 18, "37"))
    rows = load(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", iban.alias("iban"))
    return rows.withColumn("remainder", expressions.iban_remainder(F.col("iban")))


# ---- guards and projections ------------------------------------------------------------------------------------


@query("SELECT scan_id, CASE WHEN text IS NULL OR length(text) < 1 THEN 'empty' WHEN scan_language IS NULL OR scan_language NOT IN ('en', 'vi') THEN 'unsupported_language' WHEN length(text) > 50000 THEN 'too_long' ELSE 'ok' END AS status FROM scan_requests")
def scan_status(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select("scan_id", detect.status(F.col("text"), F.col("scan_language"), ("en", "vi")).alias("status"))


@query(ONCE + "SELECT scan_id, entity_id AS ord, span_start, span_end, substr(text, span_start + 1, span_end - span_start) AS text_val, substr(text, greatest(span_start - 40, 0) + 1, least(length(text), span_end + 40) - greatest(span_start - 40, 0)) AS context_snippet FROM once JOIN scan_requests USING (scan_id)")
def span_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).join(requests(spark, sf).select("scan_id", "text"), "scan_id")
    value = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    return rows.select("scan_id", "ord", "span_start", "span_end", value.alias("text_val"), expressions.snippet(F.col("text"), F.col("span_start"), F.col("span_end")).alias("context_snippet"))


@query(ONCE + "SELECT scan_id, entity_id AS ord, entity_type, round(score, 3) AS score FROM once JOIN scan_requests USING (scan_id) WHERE score >= confidence_threshold")
def above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Each request's own threshold; spans without a score don't pass."""
    rows = entities(spark, sf).join(requests(spark, sf).select("scan_id", "confidence_threshold"), "scan_id")
    return rows.where("score >= confidence_threshold").select("scan_id", "ord", "entity_type", F.round("score", 3).alias("score"))


# ---- span algebra ----------------------------------------------------------------------------------------------


@query(ONCE + "SELECT scan_id, span_start, span_end, entity_type, score FROM once QUALIFY row_number() OVER (PARTITION BY scan_id, span_start, span_end ORDER BY score DESC NULLS LAST, entity_id, entity_type) = 1")
def exact_span_best(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.best_per_span(entities(spark, sf), "scan_id").select("scan_id", "span_start", "span_end", "entity_type", "score")


@query(
    ONCE + """, placed AS (SELECT *, max(span_end) OVER (PARTITION BY scan_id ORDER BY span_start, span_end, entity_id, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
    row_number() OVER (PARTITION BY scan_id ORDER BY span_start, span_end, entity_id, entity_type) AS place FROM once),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY place) AS island FROM placed)
    SELECT scan_id, min(span_start) AS span_start, max(span_end) AS span_end, first(entity_type ORDER BY coalesce(score, -1) DESC, place) AS entity_type, max(score) AS score FROM islands GROUP BY scan_id, island"""
)
def overlap_union(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.union_overlapping(entities(spark, sf), "scan_id")


DEEP = ("PERSON", "ORGANIZATION", "LOCATION")


@query(ONCE + "SELECT scan_id, entity_id AS ord, entity_type, span_start, span_end FROM once b WHERE entity_type NOT IN ('PERSON', 'ORGANIZATION', 'LOCATION') AND NOT (entity_type NOT IN ('HR_SENSITIVE_CONTENT', 'IP_TRADE_SECRET_CONTENT') AND EXISTS (SELECT 1 FROM once d WHERE d.entity_type IN ('PERSON', 'ORGANIZATION', 'LOCATION') AND d.scan_id = b.scan_id AND b.span_start < d.span_end AND d.span_start < b.span_end))")
def overlap_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Names stand for a deep pass; what they overlap is dropped, topic flags stay."""
    rows = entities(spark, sf)
    base, deep = rows.where(~F.col("entity_type").isin(*DEEP)), rows.where(F.col("entity_type").isin(*DEEP))
    return resolve.drop_overlapped(base, deep, "scan_id").select("scan_id", "ord", "entity_type", "span_start", "span_end")


@query(ONCE + "SELECT scan_id, entity_type, count(*) AS n FROM (SELECT scan_id, entity_type FROM once b WHERE entity_type NOT IN ('PERSON', 'ORGANIZATION', 'LOCATION') AND NOT (entity_type NOT IN ('HR_SENSITIVE_CONTENT', 'IP_TRADE_SECRET_CONTENT') AND EXISTS (SELECT 1 FROM once d WHERE d.entity_type IN ('PERSON', 'ORGANIZATION', 'LOCATION') AND d.scan_id = b.scan_id AND b.span_start < d.span_end AND d.span_start < b.span_end)) UNION ALL SELECT scan_id, entity_type FROM once WHERE entity_type IN ('PERSON', 'ORGANIZATION', 'LOCATION')) GROUP BY scan_id, entity_type")
def deep_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    merged = resolve.merge_deep(rows.where(~F.col("entity_type").isin(*DEEP)), rows.where(F.col("entity_type").isin(*DEEP)), "scan_id")
    return risk.entity_counts(merged, "scan_id")


# ---- masking ---------------------------------------------------------------------------------------------------

MASK = (
    ONCE + """, placed AS (SELECT *, max(span_end) OVER (PARTITION BY scan_id ORDER BY span_start, span_end, entity_id, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
    row_number() OVER (PARTITION BY scan_id ORDER BY span_start, span_end, entity_id, entity_type) AS place FROM once WHERE entity_type NOT IN ('HR_SENSITIVE_CONTENT', 'IP_TRADE_SECRET_CONTENT')),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY place) AS island FROM placed),
    united AS (SELECT scan_id, min(span_start) AS a, max(span_end) AS b, first(entity_type ORDER BY coalesce(score, -1) DESC, place) AS t FROM islands GROUP BY scan_id, island),
    pieces AS (SELECT u.scan_id, a, b, t, coalesce(lag(b) OVER (PARTITION BY u.scan_id ORDER BY a), 0) AS before, text FROM united u JOIN scan_requests USING (scan_id)),
    done AS (SELECT scan_id, string_agg(substr(text, before + 1, a - before) || {label}, '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS masked FROM pieces GROUP BY scan_id)
    SELECT scan_id, coalesce(masked, text) AS masked FROM scan_requests LEFT JOIN done USING (scan_id)"""
)


@query(MASK.format(label="'<' || t || '>'"))
def anonymized(spark: SparkSession, sf: str) -> DataFrame:
    return mask.mask(requests(spark, sf), entities(spark, sf), "scan_id", "text")


@query(MASK.format(label="''"))
def deleted(spark: SparkSession, sf: str) -> DataFrame:
    return mask.mask(requests(spark, sf), entities(spark, sf), "scan_id", "text", tag=False)


@query()
def redacted_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Detection, union and masking in one; a text with a span that cannot be placed has no output."""
    rows = requests(spark, sf)
    return mask.fail_closed(rows, detect.detect(rows, "scan_id", "text"), "scan_id", "text")


# ---- risk ------------------------------------------------------------------------------------------------------

WEIGHTS = "(VALUES " + ", ".join(f"('{t}', '{n}', {w})" for t, (n, w) in rules.SEVERITY.items()) + ") AS s(entity_type, tier, weight)"
RISK = ONCE + f""", found AS (SELECT scan_id, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'sensitive') AS sensitive, count(*) FILTER (tier = 'review') AS review, count(*) AS total_entities, sum(coalesce(weight, 0))::BIGINT AS risk_score FROM once LEFT JOIN {WEIGHTS} USING (entity_type) GROUP BY scan_id),
    risk AS (SELECT r.scan_id, coalesce(critical, 0) AS critical, coalesce(sensitive, 0) AS sensitive, coalesce(review, 0) AS review, coalesce(total_entities, 0) AS total_entities, coalesce(risk_score, 0) AS risk_score FROM scan_requests r LEFT JOIN found USING (scan_id)) """


@query(RISK + "SELECT * FROM risk")
def request_risk(spark: SparkSession, sf: str) -> DataFrame:
    return risk.document_risk(requests(spark, sf), entities(spark, sf), "scan_id")


@query(RISK + "SELECT *, row_number() OVER (ORDER BY risk_score DESC, scan_id) AS risk_rank FROM risk")
def request_risk_rank(spark: SparkSession, sf: str) -> DataFrame:
    return risk.ranked(request_risk(spark, sf), "scan_id")


@query()
def doc_risk_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: documents scanned at the corpus threshold, without the exact-span dedup, and ranked by weighted risk."""
    docs = load(spark, sf, "documents", "doc_id", "text")
    found = detect.detect(docs, "doc_id", "text", threshold=rules.CORPUS_THRESHOLD)
    return risk.ranked(risk.document_risk(docs, found, "doc_id"), "doc_id")


@query(ONCE + "SELECT scan_id, entity_type, count(*) AS n FROM once GROUP BY ALL")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return risk.entity_counts(entities(spark, sf), "scan_id")


@query(ONCE + "SELECT entity_type, count(*) AS n FROM once GROUP BY ALL")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return risk.corpus_totals(entities(spark, sf))


@query(ONCE + f"SELECT tier, count(*) AS n, sum(weight)::BIGINT AS weight FROM once JOIN {WEIGHTS} USING (entity_type) GROUP BY tier")
def tier_totals(spark: SparkSession, sf: str) -> DataFrame:
    return risk.weighed(entities(spark, sf)).where("tier IS NOT NULL").groupBy("tier").agg(F.count("*").alias("n"), F.sum("weight").cast("bigint").alias("weight"))


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) FILTER (place >= greatest(floor(n * 0.95), 1)) AS nearest_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return risk.nearest_rank(load(spark, sf, "events", "event_type", "value"), "event_type", "value").withColumn("mean", F.round("mean", 6))


# ---- scanned words ---------------------------------------------------------------------------------------------


def ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "ocr_words", "word_id", "scan_id", "page_no", "block_no", "par_no", "line_no", "text", "x0", "y0", "x1", "y1")
    return ocr.word_spans(words.dropDuplicates(["word_id"]), "scan_id", "word_id", ("page_no", "block_no", "par_no", "line_no"), "text")


PLACED = """WITH seps AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN (page_no, block_no, par_no, line_no) IS NOT DISTINCT FROM lag((page_no, block_no, par_no, line_no)) OVER w THEN ' ' ELSE chr(10) END AS sep FROM ocr_words WINDOW w AS (PARTITION BY scan_id ORDER BY word_id)),
    placed AS (SELECT *, (sum(length(text) + length(sep)) OVER (PARTITION BY scan_id ORDER BY word_id))::INT AS span_end FROM seps) """


@query(PLACED + "SELECT scan_id, word_id, text, (span_end - length(text))::INT AS span_start, span_end FROM placed")
def ocr_word_spans(spark: SparkSession, sf: str) -> DataFrame:
    return ocr_words(spark, sf).select("scan_id", "word_id", "text", "span_start", "span_end")


@query("SELECT scan_id, text FROM scan_requests WHERE scan_id IN (SELECT scan_id FROM ocr_words)")
def ocr_text(spark: SparkSession, sf: str) -> DataFrame:
    """The words joined give the requests' texts."""
    return ocr.joined_text(ocr_words(spark, sf), "scan_id", "text")


BOXES = ", once AS (SELECT DISTINCT scan_id, entity_type, span_start, span_end FROM detected_entities WHERE scan_id IN (SELECT scan_id FROM ocr_words)), boxes AS (SELECT o.scan_id, o.span_start, o.span_end, entity_type, count(word_id) AS n_words, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM once o LEFT JOIN (SELECT *, span_end - length(text) AS a FROM placed) p ON o.scan_id = p.scan_id AND p.a < o.span_end AND p.span_end > o.span_start GROUP BY ALL) "


@query(PLACED + BOXES + "SELECT * FROM boxes")
def entity_boxes(spark: SparkSession, sf: str) -> DataFrame:
    placed = ocr_words(spark, sf)
    spans = entities(spark, sf).join(placed.select("scan_id").distinct(), "scan_id", "left_semi")
    return ocr.boxes_of_spans(spans, placed, "scan_id")


@query(PLACED + BOXES + "SELECT scan_id, bool_and(n_words > 0) AS located FROM boxes GROUP BY scan_id")
def entities_located(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.located(entity_boxes(spark, sf), "scan_id")


@query("SELECT o_orderkey, 'word ' || o_orderkey AS text, ((o_custkey % 1000) * 2)::DOUBLE AS x0, (o_orderkey % 1000)::DOUBLE AS y0, ((o_custkey % 1000 + 50) * 2)::DOUBLE AS x1, (o_orderkey % 1000 + 20)::DOUBLE AS y1 FROM orders")
def boxes_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a fence, drifting names and broken items; the good item of each is kept and scaled to the page."""
    k, c = F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000
    box = F.concat(F.lit("["), F.concat_ws(", ", k, c, k + 20, c + 50), F.lit("]"))
    good = F.concat(F.lit('{"'), F.when(F.col("o_orderkey") % 2 == 0, "text").otherwise("label"), F.lit('": "word '), F.col("o_orderkey"), F.lit('", "'), F.when(F.col("o_orderkey") % 3 == 0, "box").otherwise("box_2d"), F.lit('": '), box, F.lit("}"))
    raw = F.concat(F.lit("```json\n["), good, F.lit(', {"text": "short", "box": [1, 2]}, {"text": "", "box": [1, 2, 3, 4]}, {"text": "bad", "bbox": ["a", 2, 3, 4]}]\n```'))
    rows = load(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.explode(ocr.words_from_json(raw, F.lit(2000), F.lit(1000), True, 1000)).alias("w"))
    return rows.select("o_orderkey", "w.*")


# ---- names after tagging ---------------------------------------------------------------------------------------


@query()
def named_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The post-processing over a substitute tagger that marks capitalised runs."""
    return ner.named_entities(requests(spark, sf), "scan_id", "text")


@query()
def collapsed_marks(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", "doc_id", "text").select("doc_id", expressions.collapsed(F.col("text")).alias("text"))


@query("SELECT o_orderkey, list_transform([o_orderkey % 4, -1, o_custkey % 4], lambda i: CASE WHEN i = -1 THEN -1 ELSE [7, -1, 5, 0][i + 1] END)::INT[] AS composed FROM orders")
def composed_maps(spark: SparkSession, sf: str) -> DataFrame:
    outer = F.array((F.col("o_orderkey") % 4).cast("int"), F.lit(-1), (F.col("o_custkey") % 4).cast("int"))
    return load(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", expressions.composed(outer, F.array(*map(F.lit, (7, -1, 5, 0)))).alias("composed"))


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(replace(p_name, '-', ' ')), '\\s+')) AS word FROM part) WHERE length(word) >= 2 GROUP BY word")
def syllable_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ner.syllables(load(spark, sf, "part", "p_name"), "p_name").withColumnRenamed("syllable", "word")


# ---- accounts and usage ----------------------------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return govern.once(load(spark, sf, "usage_events", "usage_id", "api_key_id", "scan_id", "kind", "used_at", "received_at"))


USED = "WITH once AS (SELECT DISTINCT ON (usage_id) * FROM usage_events ORDER BY usage_id, received_at) "


@query(USED + "SELECT api_key_id, count(*) FILTER (kind = 'scan') AS requests, count(*) FILTER (kind = 'deep_scan') AS deep_scans, count(*) FILTER (kind = 'ocr_api') AS ocr_calls FROM once GROUP BY api_key_id")
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return govern.usage(events(spark, sf), "api_key_id", "kind")


@query(USED + ", n AS (SELECT usage_id, api_key_id, kind, row_number() OVER (PARTITION BY api_key_id, kind ORDER BY used_at, usage_id) AS nth FROM once) SELECT usage_id, api_key_id, kind, nth::INT AS nth, CASE kind WHEN 'deep_scan' THEN nth <= 50 WHEN 'ocr_api' THEN nth <= 30 ELSE true END AS admitted FROM n")
def quota_admitted(spark: SparkSession, sf: str) -> DataFrame:
    return govern.admitted(events(spark, sf), "api_key_id", "kind", "used_at", "usage_id").select("usage_id", "api_key_id", "kind", "nth", "admitted")


@query(USED + "SELECT usage_id, api_key_id, count(*) OVER (PARTITION BY api_key_id ORDER BY epoch_us(used_at) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM once")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return govern.arrivals(events(spark, sf), "api_key_id", "used_at").select("usage_id", "api_key_id", "in_window")


@query(USED + "SELECT k.api_key_id, count(o.usage_id) AS calls FROM api_keys k LEFT JOIN once o USING (api_key_id) GROUP BY k.api_key_id")
def calls_of_known_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = load(spark, sf, "api_keys", "api_key_id")
    calls = govern.known_keys(events(spark, sf), keys, "api_key_id").groupBy("api_key_id").agg(F.count("*").alias("calls"))
    return keys.join(calls, "api_key_id", "left").fillna(0, ["calls"])


@query("SELECT lower(email) AS email FROM (SELECT email FROM users UNION SELECT 'new' || c_custkey || '@example.org' FROM customer) WHERE email NOT IN (SELECT email FROM users)")
def new_accounts(spark: SparkSession, sf: str) -> DataFrame:
    users = load(spark, sf, "users", "email")
    new = load(spark, sf, "customer", "c_custkey").select(F.concat(F.lit("new"), F.col("c_custkey"), F.lit("@example.org")).alias("email"))
    return govern.registered(users, users.unionByName(new), "email")


@query("SELECT DISTINCT replace(m, 'models/', '') AS model FROM (SELECT 'models/gemini-' || CASE p_size % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'flash' ELSE 'nano' END || '-' || (p_size % 5) || CASE p_size % 7 WHEN 0 THEN '-image' WHEN 1 THEN '-tts' ELSE '' END AS m FROM part) WHERE (m LIKE '%pro%' OR m LIKE '%flash%') AND m NOT LIKE '%image%' AND m NOT LIKE '%tts%'")
def usable_models(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    kind = F.when(s % 3 == 0, "pro").when(s % 3 == 1, "flash").otherwise("nano")
    name = F.concat(F.lit("models/gemini-"), kind, F.lit("-"), s % 5, F.when(s % 7 == 0, "-image").when(s % 7 == 1, "-tts").otherwise(""))
    return govern.text_models(load(spark, sf, "part", "p_size").select(name.alias("model")), "model")


@query()
def deep_scan_status(spark: SparkSession, sf: str) -> DataFrame:
    """Without a key every text is skipped, none is lost."""
    return govern.deep_scan(requests(spark, sf), "scan_id", "text").select("scan_id", "status")
