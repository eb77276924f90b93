"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import conversations, decontaminate, exact_dedup, hard_negatives, html_extract, language_id, line_dedup, mixing, near_dedup, quality, secrets, simhash, token_output
from rillstone.llm.common import encode, map_rows, read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scanned; a document is its own repository, its source the owner."""
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts to ids, written in the range-coded format in order of ids and read back from it."""
    return token_output.token_output(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: words hit by windows, items named, and items whose words lie close together."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, items, near=True)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents towards the square root of their sources' sizes."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels table and the unlabelled documents."""
    return quality.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, with a digest of what its bitmap keeps."""
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), with_text=True)

    def digest(x: dict) -> Iterator[dict]:
        kept = (line_dedup.kept_lines(t, k) for t, k in zip(x["text"], x["keep"], strict=True))
        yield {c: x[c] for c in ("doc_id", "n_lines", "n_dropped")} | {
            "kept_sha256": [hashlib.sha256(encode(t)).hexdigest() for t in kept]
        }

    out = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    return map_rows(found, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", out)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of every text; of equal ones the greatest id stays."""
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), largest=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the labelled rows of the fold."""
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 is an anchor; where it is divisible by 7 the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of damaged conversations and a digest of each repaired one; those that lost all rows are empty."""
    whole = read_table(spark, sf_dir, "conversations")
    report, repaired = conversations.repair(conversations.damaged(whole))
    found = report.join(conversations.text_digests(repaired).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    out = whole.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_output,
        op3_decontamination,
        op4_mixing,
        op5_html_extraction,
        op6_quality,
        op7_line_dedup,
        op8_exact_dedup,
        op9_near_dedup,
        op10_language_id,
        op11_hard_negatives,
        op12_conversation_repair,
        op13_simhash,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _edit(state: str, letter: str, cost: str) -> str:
    """SQL of a way (cost, audit, plan) one edit longer. Letters as in conversations: a plan tells users from assistants."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{conversations.audit_of(letter)}', 'p': {state}.p || '{letter}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


#: After a row, the cheapest way to each state (nothing, system, user, assistant); 'no' is dearer than any way.
_NO = 1_000_000
_MORE = "(CASE WHEN cut THEN 1 ELSE 0 END)"
_TAKES = lambda role: f"(CASE WHEN NOT gone AND ini = '{role}' THEN {_MORE} ELSE {_NO} END)"
_REROLE = f"(CASE WHEN gone THEN {_NO} ELSE 2 + {_MORE} END)"
_STEP = f"""
    {_edit('a0', 'D', '3')} AS b0,
    {_least(_edit('a1', 'D', '3'), _edit('a0', 'K', _TAKES('s')))} AS b1,
    {_least(_edit('a2', 'D', '3'), *(_edit(x, 'K', _TAKES('u')) for x in ('a0', 'a1', 'a3')), *(_edit(x, 'U', _REROLE) for x in ('a0', 'a1', 'a3')))} AS b2,
    {_least(_edit('a3', 'D', '3'), _edit('a2', 'K', _TAKES('a')), _edit('a2', 'A', _REROLE))} AS b3"""
_INSERTED_USER = _least("b2", *(_edit(x, "u", "2") for x in ("b0", "b1", "b3")))

ORACLE_SQL = {
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
              FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
                           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c, x) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))), 4294967295) % 20 AS k
            FROM conversations),
        d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM k, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                     left(role, 1) AS ini, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS mark
              FROM d),
        f AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before
              FROM o),
        r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, fault = 'truncated' AS cut FROM f),
        n AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                     count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                     count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
              FROM r GROUP BY conv_id),
        dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'p': ''}} AS a0, {{'c': {_NO}, 'a': '', 'p': ''}} AS a1,
                      {{'c': 2, 'a': 'I', 'p': 'u'}} AS a2, {{'c': 4, 'a': 'II', 'p': 'ua'}} AS a3
               FROM n
               UNION ALL
               SELECT conv_id, i, b0, b1, c2, {_least("b3", _edit("c2", "a", "2"))}
               FROM (SELECT *, {_INSERTED_USER} AS c2
                     FROM (SELECT r.conv_id, r.i, {_STEP} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
        w AS (SELECT n.*, list_min([a0, a3]) AS way FROM n JOIN dp ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.last = dp.i),
        t AS (SELECT conv_id, unnest(regexp_extract_all(way.p, '[ua]*[KUAD](?:[ua]*$)?')) AS edits,
                     generate_subscripts(regexp_extract_all(way.p, '[ua]*[KUAD](?:[ua]*$)?'), 1) AS i FROM w),
        l AS (SELECT conv_id, i, unnest(string_split(edits, '')) AS letter, generate_subscripts(string_split(edits, ''), 1) AS j FROM t),
        x AS (SELECT l.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role || ':' || text WHEN 'U' THEN 'user:' || text
                          WHEN 'A' THEN 'assistant:' || text WHEN 'u' THEN 'user:' ELSE 'assistant:' END, chr(10) ORDER BY l.i, j)) AS h
              FROM l JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
               coalesce(way.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op3_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
               FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
               FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(s)),
        hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (n, k)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
        iu AS (SELECT DISTINCT item_id, len(w) AS size, unnest(w) AS word FROM i),
        sizes AS (SELECT item_id, size, count(*) AS n FROM iu GROUP BY ALL),
        du AS (SELECT DISTINCT doc_id, unnest(w) AS word FROM d),
        holds AS (SELECT doc_id, item_id, any_value(iu.size) AS size FROM du JOIN iu USING (word) JOIN sizes USING (item_id)
                  GROUP BY doc_id, item_id, sizes.n HAVING count(*) = sizes.n),
        spot AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM holds)),
        mine AS (SELECT h.doc_id, h.item_id, h.size, spot.word, spot.p FROM holds h JOIN iu ON iu.item_id = h.item_id JOIN spot ON spot.doc_id = h.doc_id AND spot.word = iu.word),
        near AS (SELECT DISTINCT a.doc_id, a.item_id FROM mine a JOIN mine b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + 2 * a.size
                 JOIN sizes s ON s.item_id = a.item_id GROUP BY a.doc_id, a.item_id, a.p, s.n HAVING count(DISTINCT b.word) = s.n),
        nears AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)""",
    "op4_mixing": """
        WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
        t AS (SELECT sum(n) AS a, sum(w) AS w FROM n),
        r AS (SELECT source, n.w / t.w * t.a * 1.0 / n.n AS rate FROM n, t),
        m AS (SELECT source, greatest(ceil(rate / 32.0), 1)::INT AS pieces, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM r),
        c AS (SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf, mean FROM m
              UNION ALL
              SELECT source, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1), mean FROM c
              WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
        u AS (SELECT doc_id, d.source, j,
                     ('0x' || md5('1|' || doc_id || '|' || j)[1:13])::BIGINT / 4503599627370496.0 AS u
              FROM documents d JOIN m USING (source), unnest(range(1, pieces + 1)) AS t(j)),
        x AS (SELECT doc_id, count(*) FILTER (WHERE cdf <= u) AS copies FROM u JOIN c USING (source) GROUP BY doc_id)
        SELECT d.*, copy_no::INT AS copy_no, md5('order|1|' || doc_id || '|' || copy_no) AS shuffle_key
        FROM documents d JOIN x USING (doc_id), unnest(range(1, copies + 1)) AS t(copy_no)""",
    "op7_line_dedup": rf"""
        WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        s AS (SELECT k.*, f.key IS NULL OR doc_id = top AS kept FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT kept)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '')) AS kept_sha256
        FROM s GROUP BY doc_id""",
    "op8_exact_dedup": rf"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256({_LOWER}) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY {_LOWER})""",
}
