"""The registered queries of the corpus operators: thin wrappers that apply them to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import chat, counts, decontam, divergence, fingerprint, langid, lattice, packing, sharding, simhash, tokenfile, tokens, toxicity, trie
from footfall.llm.common import read_table, shared_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    ids = tokens.token_ids(read_table(spark, sf_dir, "documents"), end_id=1)
    items = packing.pieces(ids, 4096).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, 4096)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each text and of its edit: the last quarter replaced by the next document's start."""
    docs = fingerprint.with_next(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.col("next_text"), F.lit(1), quarter))
    docs = docs.withColumn("edited", edited)
    trees = docs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.tree(F.col("text")).alias("own"),
        fingerprint.tree(F.col("edited")).alias("after"),
        fingerprint.tree(F.col("next_text")).alias("following"),
    )
    own = F.col("own")
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.root(own).alias("fingerprint"),
        fingerprint.root(F.col("after")).alias("edited_fingerprint"),
        fingerprint.likeness(own, F.col("after")).alias("near_edited"),
        fingerprint.likeness(own, F.col("following")).alias("near_next"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return decontam.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_trees(chat.from_turns(turns)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from four fifths of the labels."""
    scored = toxicity.toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through token files and back."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write_token_files(read_table(spark, sf_dir, "documents"), path, end_id=2)
    return tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice score of every document, learnt from four fifths of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (~held_out).alias("train"))
    return lattice.lattice_scores(docs, class_col="lang").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, counted between the ends of documents in flat files of all of them."""
    path = f"{shared_dir(spark)}/flat-tokens-{uuid.uuid4().hex}"
    counts.write_flat(read_table(spark, sf_dir, "documents"), path)
    return counts.token_counts(spark, path).select("doc_id", "n_tokens")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the hash tree, and where they would be with one more."""
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every source of every language: all its peers, and its 200 most telling terms."""
    out = divergence.divergence(read_table(spark, sf_dir, "documents"))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return langid.predictions(docs, ~F.col("held_out"), keep=("held_out",))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations, rebuilt with the first turns of every twentieth."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    nodes = trie.trie(trie.with_shared_heads(read_table(spark, sf_dir, "conversations"), 20, head, 3))
    return nodes.withColumn("depth", F.col("depth").cast("long"))


def queries() -> dict:
    registered = (
        op1_best_fit_packing, op2_document_fingerprints, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_chat_formatting, op6_toxicity, op7_token_files,
        op8_lattice_scores, op9_token_counts, op10_sharding, op11_source_divergence, op12_language_id, op13_conversation_trie,
    )
    return {f.__name__: f for f in registered}


_CUTS = r"list_transform(string_split({0}, chr(10)), lambda p: string_split(regexp_replace(p, '([n.,;:!?|)][ \t\r\f\x0B]+)', '\1' || chr(1), 'g'), chr(1)))"
_LEAVES = f"list_transform({_CUTS}, lambda p: list_transform(p, lambda x, i: left(CASE WHEN x = '' THEN md5('') ELSE md5(CASE WHEN i > 1 THEN p[i - 1] ELSE '' END || chr(1) || x) END, 16)))"
_NODES = "list_transform({0}, lambda p: sha256(array_to_string(p, ' ')))"
_SECTIONS = "list_transform(string_split(regexp_replace(array_to_string({0}, ' '), '(\\b[0-3][0-9a-f]+) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: sha256(s))"
_COUNTED = "list_filter(flatten({0}), lambda x: x <> left(md5(''), 16))"
_ROOT = f"sha256(array_to_string({_SECTIONS.format(_NODES)}, ''))"


def _likeness_sql(other: str, to: str) -> str:
    """The leaves that both trees have, each as often as both have it, and whether the roots are equal."""
    return f"""{to} AS (
  SELECT n.row, (2 * coalesce(s.shared, 0) + 2 * CAST(n.text = n.{other} AS INT))::DOUBLE / (len(n.p0) + len(n.{other}_p) + 2) AS likeness
  FROM p AS n LEFT JOIN (
    SELECT a.row, sum(least(a.n, b.n)) AS shared
    FROM (SELECT row, x, count(*) AS n FROM (SELECT row, unnest(p0) AS x FROM p) GROUP BY ALL) AS a
    JOIN (SELECT row, x, count(*) AS n FROM (SELECT row, unnest({other}_p) AS x FROM p) GROUP BY ALL) AS b ON a.row = b.row AND a.x = b.x
    GROUP BY a.row) AS s ON s.row = n.row)"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT row_number() OVER () AS row, doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text FROM d),
e AS (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM n),
l AS (SELECT *, {_LEAVES.format('text')} AS l0, {_LEAVES.format('edited')} AS l1, {_LEAVES.format('next_text')} AS l2 FROM e),
p AS (SELECT *, {_COUNTED.format('l0')} AS p0, {_COUNTED.format('l1')} AS edited_p, {_COUNTED.format('l2')} AS next_text_p FROM l),
{_likeness_sql('edited', 'near')}, {_likeness_sql('next_text', 'far')}
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_ROOT.format('l0')} AS fingerprint, {_ROOT.format('l1')} AS edited_fingerprint,
  near.likeness AS near_edited, far.likeness AS near_next
FROM p JOIN near USING (row) JOIN far USING (row)"""

_ESCAPE = "replace(replace(replace(replace({0}, '<&', '<&&'), '<s>', '<&s>'), '</s>', '<&/s>'), '<t>', '<&t>')"

OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(10 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')})) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c"""


def _least_sql(name: str, weights: list[float]) -> str:
    """The least draw below a node, and which of at most five children it is: six hexadecimal digits of one digest for each."""
    u = f"(('0x' || substr(md5(k || {name} || '0'), 6 * (i - 1) + 1, 6))::BIGINT + 1.0::DOUBLE) / {float(16**6 + 1)}::DOUBLE"
    return f"list_sort(list_transform({[f'{w}' for w in weights]}::DOUBLE[], lambda w, i: {{'draw': -ln({u}) / w, 'at': i - 1}}))[1]"


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
bits AS (SELECT list(b ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS b FROM (SELECT unnest(range(0, 256))::BIGINT AS n))),
s AS (
  SELECT row, doc_id, k, (octet_length(encode(text)) + 16)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32
  FROM d, bits),
g AS (SELECT *, {_least_sql("'/'", [10.0] * 4)} AS region, {_least_sql("'/more/'", [1.0])} AS more FROM s),
r AS (SELECT *, {_least_sql("'/' || region.at || '/'", [5.0] * 2)} AS rack FROM g),
l AS (SELECT *, {_least_sql("'/' || region.at || '/' || rack.at || '/'", [1.0] * 5)} AS place FROM r),
p AS (SELECT *, (10 * region.at + 5 * rack.at + place.at)::INT AS shard FROM l)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 6))::BIGINT % 64, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
  CASE WHEN more.draw < region.draw THEN 40 ELSE shard END::INT AS grown_shard FROM p"""


_SHARE = "(1 + (1000000000::HUGEINT * ({0} + 1)) // ({1} + {2}))"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
t AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(x.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) AS x USING (lang, source) GROUP BY ALL),
f AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'g.total', 'g.v')} AS p, {_SHARE.format('l.n', 't.total', 'g.v')} AS q
  FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f AS a JOIN f AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""

OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(b ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS b FROM (SELECT unnest(range(0, 256))::BIGINT AS n))),
a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, role, sha256(length(role) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM a),
o AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, role, id) AS ids, list(words ORDER BY turn NULLS FIRST, role, id) AS words FROM i GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 4 AS h FROM o, bits),
r AS (SELECT x.conv_id, coalesce(b.ids[1:h], []) || x.ids[h + 1:] AS ids, coalesce(b.words[1:h], []) || x.words[h + 1:] AS words FROM h AS x LEFT JOIN o AS b ON b.conv_id = x.conv_id - x.conv_id % 20),
k AS (SELECT conv_id, d, len(ids) = d AS ends, sha256(array_to_string(ids[1:d], '')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM r)),
n AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM k GROUP BY d, key),
c AS (SELECT up AS key, d - 1 AS d, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (key, d)),
s AS (SELECT k.key, k.d, count(*) FILTER (m.children = 0) AS leaves, sum((m.n - 1) * m.words) AS saved FROM m JOIN k ON k.conv_id = m.conv_id AND k.d <= m.d GROUP BY k.key, k.d)
SELECT m.conv_id, m.d::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, m.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (key, d) LEFT JOIN n AS p ON p.key = m.up AND p.d = m.d - 1"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op13_conversation_trie": OP13_SQL, "op2_document_fingerprints": OP2_SQL, "op5_chat_formatting": OP5_SQL, "op10_sharding": OP10_SQL}
