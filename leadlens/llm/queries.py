"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlens.llm import audio, spiece
from leadlens.llm.ann import near_embeddings
from leadlens.llm.common import table
from leadlens.llm.html_text import extract_text
from leadlens.llm.minhash import near_duplicates
from leadlens.llm.mixing import mix_sources
from leadlens.llm.packing import best_fit_pack
from leadlens.llm.pii import find_spans
from leadlens.llm.repair import audit_conversations
from leadlens.llm.sharding import shard_documents
from leadlens.llm.suffix import remove_repeats
from leadlens.llm.toxicity import score_toxicity
from leadlens.llm.variants import spelling_variants


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with two-word shingle sets at 0.8 or more; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token piece with its sequence of at most 4096 tokens and its place there; see best_fit_pack()."""
    return best_fit_pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of every text stored as mu-law audio and of its stored PCM; see digests()."""
    return audio.digests(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text, by certain forms and by weak supervision; see find_spans()."""
    return find_spans(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text decoded from them; see encode()."""
    return spiece.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), as_ids=False)


def op6_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, equal texts together; see shard_documents()."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label at cosine 0.98 or more; see near_embeddings()."""
    return near_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text; see score_toxicity()."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings of smaller ids; see remove_repeats()."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; see extract_text()."""
    return extract_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of every conversation; see audit_conversations()."""
    return audit_conversations(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the form that each is a variant of; see spelling_variants()."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix by source takes each document; see mix_sources()."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS low FROM w UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT id, min(low) AS low FROM r GROUP BY id) m ON m.id = w.doc_id
"""


#: Links by brute force within each label; sums in double precision.
OP7_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL
), g AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.size > 0 AND b.size > 0 WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), r AS (
  SELECT vec_id AS id, vec_id AS low FROM e UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b
), m AS (SELECT id, min(low) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(links, 0) AS n_links, low AS component_id, e.vec_id = low AS kept FROM e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

#: Texts as hexadecimal digits, two for a byte; every 50-byte string with the least id that has it.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL
), w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)
), x AS (SELECT w.doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY 1) USING (s) WHERE least < w.doc_id
), o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM x
), r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY 1, 2
), b AS (SELECT doc_id, k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r
), c AS (SELECT d.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY k) || substring(any_value(h), 2 * max(hi) + 1) AS kept, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM b JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


def crc32_sql(text: str) -> str:
    """An unsigned crc32 in DuckDB, which has none: UTF-8 bytes as hexadecimal digits, half a byte a step."""
    steps = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    digits = f"hex(encode({text}))"
    halves = f"list_transform(range(0, length({digits})), lambda i: strpos('0123456789ABCDEF', substring({digits}, CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {halves}), lambda c, v: xor(CAST({steps} AS BIGINT[])[1 + (xor(c, v) & 15)], c >> 4)), 4294967295)"


def _edit(w: str, label: str, cost: str) -> str:
    """A weight, nine digits of cost and the edits, with an edit before it."""
    return f"lpad(CAST(CAST(left({w}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{label}' || substring({w}, 10)"


#: Weights from the last turn to the first, one for each state of the grammar; strings order as (cost, edits) do.
OP11_SQL = f"""
WITH RECURSIVE c AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations
), d AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE h <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d
), f AS (
  SELECT c, i, turn, role, text, left(role, 1) AS r, CASE WHEN e = '' THEN 'b' WHEN k > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM o
), g AS (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more, fault IN ('-', 't') AS may, lead(r) OVER (PARTITION BY c ORDER BY i) AS n FROM f
), w AS (
  SELECT c, max(i) + 1 AS i, '000000000' AS w0, '000000006II' AS w1, '000000003I' AS w2, '000000000' AS w3 FROM f GROUP BY c
  UNION ALL
  SELECT c, i, least(b0, {_edit('b2', 'I', '3')}, {_edit(f"({_edit('b3', 'I', '3')})", 'I', '3')}), least(b1, {_edit('b2', 'I', '3')}, {_edit(f"({_edit('b3', 'I', '3')})", 'I', '3')}), least(b2, {_edit('b3', 'I', '3')}), least(b3, {_edit('b2', 'I', '3')}) FROM (
    SELECT g.c, g.i,
      least({_edit('w0', 'D', '4')}, CASE WHEN may AND r = 's' THEN {_edit('w1', 'K', 'more')} WHEN may AND r = 'u' THEN {_edit('w2', 'K', 'more')} END, CASE WHEN may THEN {_edit('w2', 'R', '3 + more')} END) AS b0,
      least({_edit('w1', 'D', '4')}, CASE WHEN may AND r = 'u' THEN {_edit('w2', 'K', 'more')} END, CASE WHEN may THEN {_edit('w2', 'R', '3 + more')} END) AS b1,
      least({_edit('w2', 'D', '4')}, CASE WHEN may AND r = 'a' THEN {_edit('w3', 'K', 'more')} END, CASE WHEN may THEN {_edit('w3', 'R', '3 + more')} END) AS b2,
      least({_edit('w3', 'D', '4')}, CASE WHEN may AND r = 'u' THEN {_edit('w2', 'K', 'more')} END, CASE WHEN may THEN {_edit('w2', 'R', '3 + more')} END) AS b3
    FROM w JOIN g ON g.c = w.c AND g.i = w.i - 1)
), a AS (SELECT c, CAST(left(w0, 9) AS BIGINT) AS cost, substring(w0, 10) AS audit FROM w WHERE i = 1
), l AS (SELECT c, j, audit[j] AS x, count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY c ORDER BY j) AS i FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)
), m AS (SELECT l.c, j, x, role, text, count(*) FILTER (NOT (x = 'K' AND r = 's')) OVER (PARTITION BY l.c ORDER BY j) AS z FROM l LEFT JOIN f ON f.c = l.c AND f.i = l.i WHERE x <> 'D'
), h AS (SELECT c, sha256(string_agg(CASE WHEN x = 'K' THEN role || ':' || text WHEN z % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN x = 'R' THEN text ELSE '' END, chr(10) ORDER BY j)) AS repaired_sha256 FROM m GROUP BY c
), s AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (n IS NOT NULL AND r || n NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c
), e AS (SELECT DISTINCT c, conv_id FROM c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM e LEFT JOIN s USING (c) LEFT JOIN a USING (c) LEFT JOIN h USING (c)
"""

#: Near words by what is left of them without one letter.
OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), g AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY 1, 2
), h AS (SELECT run, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g
), d AS (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h
), v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), x AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word
), b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word
), f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word
), t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word WHERE t.next IS NULL
"""


def _mended(k: int) -> str:
    """Documents of one size of each source taken once more or less, those which bring it nearest to its target."""
    return f"""
), g{k} AS (SELECT source, any_value(floor(target + 0.5)) - sum(copies * size) AS gap FROM k{k} GROUP BY source
), r{k} AS (SELECT k.source, k.size, gap, least(CASE WHEN gap > 0 THEN 2 * n - copies ELSE copies END, greatest(1, floor(abs(gap) / k.size))) AS some_ FROM k{k} k JOIN g{k} g ON g.source IS NOT DISTINCT FROM k.source AND gap <> 0 AND k.size > 0
), q{k} AS (SELECT source, size, sign(gap) * some_ AS some_, row_number() OVER (PARTITION BY source ORDER BY abs(abs(gap) - some_ * size), size DESC) AS place FROM r{k} WHERE some_ > 0 AND abs(abs(gap) - some_ * size) < abs(gap)
), k{k + 1} AS (SELECT k.* REPLACE (copies + coalesce(some_, 0) AS copies) FROM k{k} k LEFT JOIN q{k} q ON place = 1 AND q.source IS NOT DISTINCT FROM k.source AND q.size = k.size"""


_GIVEN = "list_sum(list_transform(cells, lambda z: z.n * z.size * 2.0 / (1 + exp(-b * z.x))))"
_SLOPE = "list_sum(list_transform(cells, lambda z: z.n * z.size * z.x * 2.0 * exp(-abs(b * z.x)) / (1 + exp(-abs(b * z.x))) ** 2))"
OP13_SQL = (
    f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, count(*) FILTER (size > 0) AS m FROM d GROUP BY source
), w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM p
), o AS (
  SELECT *, 1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, sum(w) OVER (ORDER BY 2.0 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w
), l AS (SELECT CAST(r AS DOUBLE) AS r, CAST(ws AS DOUBLE) AS ws FROM o WHERE r * w <= 2 * s * ws ORDER BY 2.0 * s / w, source LIMIT 1
), t AS (SELECT source, s, m, CASE WHEN r * w > 2 * s * ws THEN 2.0 * s ELSE r * w / ws END AS target FROM w, l
), c AS (SELECT c.source, size, n, size * m / greatest(s, 1) AS x, s, target FROM (SELECT source, size, count(*) AS n FROM d GROUP BY 1, 2) c JOIN t ON t.source IS NOT DISTINCT FROM c.source
), a AS (SELECT source, any_value(s) AS s, any_value(target) AS target, list({{'n': n, 'size': size, 'x': x}} ORDER BY size) AS cells FROM c WHERE size > 0 AND target > 0 AND target < 2 * s GROUP BY source
), b AS (SELECT source, list_reduce(list_prepend(0.0, CAST(range(40) AS DOUBLE[])), lambda b, i: b - (ln({_GIVEN} / (2 * s - {_GIVEN})) - ln(target / (2 * s - target))) / ({_SLOPE} * (1 / {_GIVEN} + 1 / (2 * s - {_GIVEN})))) AS tilt FROM a
), e AS (SELECT c.*, CASE WHEN target <= 0 THEN 0.0 WHEN target >= 2 * s THEN 2.0 ELSE 2 / (1 + exp(-tilt * x)) END AS rate FROM c LEFT JOIN b ON b.source IS NOT DISTINCT FROM c.source
), u AS (SELECT *, floor(sum(n * rate) OVER (PARTITION BY source ORDER BY size DESC) + 0.500001) AS up FROM e
), k0 AS (SELECT source, size, n, s, target, up - lag(up, 1, 0) OVER (PARTITION BY source ORDER BY size DESC) AS copies FROM u"""
    + "".join(map(_mended, range(8)))
    + """
), z AS (SELECT d.*, k.s, k.target, CAST(k.copies AS BIGINT) AS copies, k.n, row_number() OVER (PARTITION BY d.source, d.size ORDER BY key) AS place FROM d JOIN k8 k ON k.source IS NOT DISTINCT FROM d.source AND k.size = d.size)
SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target, size * (copies // n + CASE WHEN place <= copies % n THEN 1 ELSE 0 END) AS taken FROM z
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_telephony_audio": op3_telephony_audio,
        "op4_personal_data": op4_personal_data,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_karmarkar_karp_shards": op6_karmarkar_karp_shards,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_html_extraction": op10_html_extraction,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_entropy_balanced_mix": op13_entropy_balanced_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op7_embedding_near_dedup": OP7_SQL,
        "op9_suffix_array_dedup": OP9_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_entropy_balanced_mix": OP13_SQL,
    }
