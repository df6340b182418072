"""The operators' queries over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: piece count, digest of the ids, and whether decoding gives the text back."""
    from foliant.llm.sentencepiece_codec import encode, small_batches

    small_batches(spark)
    there = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    text = F.coalesce("text", F.lit(""))
    return there.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.md5("ids").alias("ids_digest"), (F.col("decoded") == text).alias("round_trip"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")).drop("text", "lang")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def quoting(conversations: DataFrame) -> DataFrame:
    """`conversations` with quotations, which the table has none of: of three turns the second quotes the first line of the turn before, and the third that of the two turns before, nested.

    The earlier turns come by joins on conversation and turn, so a hot conversation is spread by turn.
    """
    line = conversations.groupBy("conv_id", "turn").agg(F.min(F.split("text", "\n")[0]).alias("line"))
    before = lambda k: line.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("line").alias(f"q{k}")).where(F.col("turn") % 3 >= k)
    both = conversations.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    said = lambda k: F.coalesce(F.concat(F.lit(">" * k + " "), f"q{k}", F.lit("\n")), F.lit(""))
    return both.withColumn("text", F.concat(said(1), said(2), "text")).drop("q1", "q2")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all conversations, with quotations put in by quoting()."""
    from foliant.llm.chat_format import quotation_links, reply_order

    out = reply_order(quotation_links(quoting(table(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "turn", "role", "n_quotes", "reply_to", "root_turn", "depth", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_digest"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("text_digest"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "longest")


#: Conversations of a block share a start, and shares are of fewer turns than this.
FORK_BLOCK, FORK_TURNS = 5, 9


def forked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, ...) rebuilt: each conversation begins with the first turns of the first of its block, as many as
    a hash of its id says, and goes on with its own after so many. Also its conversations, as a table of their own.

    Only the first turns of a conversation, fewer than FORK_TURNS, are gathered; its others stay rows.
    """
    first = turns.where(F.col("place") < FORK_TURNS).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "n_bytes"))).alias("first"))
    fork = F.crc32(F.col("conv_id").cast("string").cast("binary")) % FORK_TURNS
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FORK_BLOCK).alias("base"), fork.alias("fork"))
    shared = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", F.coalesce(F.filter("first", lambda x: x["place"] <= F.col("fork")), F.array()).alias("start"))
    start = shared.select("conv_id", F.explode("start").alias("x")).select("conv_id", F.col("x.place").alias("depth"), "x.h1", "x.h2", "x.n_bytes")
    own = turns.where(F.col("place") > fork).join(shared.select("conv_id", F.size("start").alias("n")), "conv_id")
    return start.unionByName(own.select("conv_id", (F.col("n") + F.col("place") - fork).alias("depth"), "h1", "h2", "n_bytes")), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by forked() so that they share starts."""
    from foliant.llm.prefix_trie import number_turns, prefix_trie

    return prefix_trie(*forked(number_turns(table(spark, sf_dir, "conversations")))).drop("position", "end_position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_dedup, op2_license_scan, op3_sentencepiece, op4_toxicity, op5_token_counts, op7_quality_rules, op6_decontaminate, op8_suffix_dedup, op9_chat_format, op10_line_dedup, op11_substring_dedup, op12_prefix_trie)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL)"
#: Components of the links l (a, b) over the nodes of a table: (id, c), c the least node reachable.
_COMPONENTS = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id, id AS c FROM nodes UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c), comp AS (SELECT id, min(c) AS c FROM r GROUP BY id)"
_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'), ' ')"

#: The same rows in plain SQL: all pairs that can be similar, all windows, all passages. The other operators are trained, or follow a tokenizer, an automaton or templates.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), nodes AS (SELECT doc_id AS id FROM n),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id""",
    "op8_suffix_dedup": f"""WITH {_WORDS},
win AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, unnest([md5(array_to_string(w[i:i + 49], ' ')) FOR i IN range(1, len(w) - 48)]) AS h FROM d WHERE len(w) >= 50),
st AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
cuts AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS cut FROM st),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cuts)
SELECT doc_id, min(p) AS first_word, max(p) + 50 AS end_word, max(p) + 50 - min(p) AS n_words FROM runs GROUP BY doc_id, run""",
    "op11_substring_dedup": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (SELECT row, unnest(range(1, len(w) - 33)) AS p, unnest([md5(array_to_string(w[i:i + 34], ' ')) FOR i IN range(1, len(w) - 33)]) AS h FROM d WHERE len(w) >= 35),
st AS (SELECT 35 AS k, row, p FROM base WHERE h IN (SELECT h FROM base GROUP BY h HAVING count(*) > 1)
  UNION ALL SELECT k, row, p FROM (SELECT 2 * st.k AS k, row, p, count(*) OVER (PARTITION BY md5(array_to_string(w[p:p + 2 * st.k - 1], ' '))) AS n FROM st JOIN d USING (row) WHERE p + 2 * st.k - 1 <= len(w)) WHERE n > 1),
far AS (SELECT row, max(k) AS longest FROM st GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(p, p + 35)) AS i FROM st WHERE k = 35),
g AS (SELECT row, list(i) AS gone FROM gone GROUP BY row),
z AS (SELECT doc_id, w, coalesce(longest, 0) AS longest, len(coalesce(gone, [])) AS n_removed, [w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)] AS kept FROM d LEFT JOIN g USING (row) LEFT JOIN far USING (row))
SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256, longest FROM z""",
    "op12_prefix_trie": r"""WITH m AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, xor(list_reduce(flatten([[ord(ch), -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295) AS crc FROM (SELECT DISTINCT conv_id FROM m)),
c AS (SELECT conv_id, crc % 9 AS h, (SELECT count(*) FROM m WHERE m.conv_id = crc.conv_id - crc.conv_id % 5) AS nb FROM crc),
r AS (SELECT c.conv_id, i AS d, role, text FROM c JOIN m ON m.conv_id = c.conv_id - c.conv_id % 5 AND i <= h UNION ALL SELECT conv_id, least(h, nb) + i - h, role, text FROM c JOIN m USING (conv_id) WHERE i > h),
k AS (SELECT conv_id, d, octet_length(encode(text)) AS b, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r),
o AS (SELECT conv_id, d, b, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY d), '') AS up FROM k UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT k, min(up) AS up, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(b) AS own FROM o GROUP BY k),
kids AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
sub AS (SELECT o.k, sum(own) AS saved, count(*) FILTER (WHERE n.k NOT IN (SELECT up FROM kids WHERE up IS NOT NULL)) AS leaves FROM n JOIN o ON o.conv_id = n.conv_id AND o.d <= n.depth GROUP BY o.k),
e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(k, d) AS k FROM o GROUP BY conv_id) GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON p.k = n.up LEFT JOIN kids ON kids.up = n.k JOIN sub ON sub.k = n.k LEFT JOIN e ON e.k = n.k""",
    "op9_chat_format": rf"""WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10))[1] AS line FROM conversations),
q AS (SELECT m.*, x.line AS q1, y.line AS q2 FROM m LEFT JOIN m x ON x.conv_id = m.conv_id AND x.turn = m.turn - 1 AND m.turn % 3 >= 1 LEFT JOIN m y ON y.conv_id = m.conv_id AND y.turn = m.turn - 2 AND m.turn % 3 >= 2),
z AS (SELECT conv_id, turn, role, {_NORM.format("q1")} AS q1, {_NORM.format("q2")} AS q2, CASE WHEN coalesce(q1, '') <> '' OR coalesce(q2, '') <> '' THEN trim(text, chr(10)) ELSE text END AS body FROM q),
x AS (SELECT conv_id, turn, {_NORM.format("p")} AS p FROM (SELECT conv_id, turn, unnest(list_concat(string_split(body, chr(10)), regexp_split_to_array(body, '\n\s*\n'), [body])) AS p FROM z)),
o AS (SELECT conv_id, p, min(turn) AS origin FROM x WHERE length(p) >= 8 GROUP BY conv_id, p),
b AS (SELECT z.*, (length(coalesce(q1, '')) >= 8)::INT + (length(coalesce(q2, '')) >= 8)::INT AS n_quotes, coalesce(CASE WHEN o1.origin < turn THEN o1.origin END, CASE WHEN o2.origin < turn THEN o2.origin END) AS reply_to
  FROM z LEFT JOIN o o1 ON o1.conv_id = z.conv_id AND o1.p = q1 LEFT JOIN o o2 ON o2.conv_id = z.conv_id AND o2.p = q2),
walk AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM b WHERE reply_to IS NULL
  UNION ALL SELECT b.conv_id, b.turn, walk.root_turn, walk.depth + 1 FROM walk JOIN b ON b.conv_id = walk.conv_id AND b.reply_to = walk.turn)
SELECT b.conv_id, b.turn, role, n_quotes, reply_to, root_turn, depth, length(body) AS n_chars, md5(body) AS text_digest FROM b JOIN walk ON walk.conv_id = b.conv_id AND walk.turn = b.turn""",
    "op10_line_dedup": rf"""WITH RECURSIVE ln AS (SELECT doc_id, k, x, lower(trim(x, ' ')) AS norm FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))),
u AS (SELECT norm, row_number() OVER (ORDER BY norm) AS id FROM (SELECT DISTINCT norm FROM ln WHERE length(norm) >= 20 AND regexp_matches(norm, '\S'))), nodes AS (SELECT id FROM u),
sh AS (SELECT DISTINCT id, unnest([substr(norm, i, 5) FOR i IN range(1, length(norm) - 3)]) AS s FROM u),
rare AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY f, s) AS k, count(*) OVER (PARTITION BY id) AS n FROM sh JOIN (SELECT s, count(*) AS f FROM sh GROUP BY s) USING (s)),
pre AS (SELECT id, s, n FROM rare WHERE k <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM pre x JOIN pre y ON x.s = y.s AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
sets AS (SELECT id, list(s) AS ss FROM sh GROUP BY id),
l AS (SELECT a, b FROM (SELECT a, b, len(x.ss) + len(y.ss) AS n, len(list_intersect(x.ss, y.ss)) AS c FROM cand JOIN sets x ON x.id = a JOIN sets y ON y.id = b) WHERE 100 * c >= 80 * (n - c)), {_COMPONENTS},
place AS (SELECT ln.*, row_number() OVER (PARTITION BY coalesce(CAST(c AS VARCHAR), '=' || ln.norm) ORDER BY doc_id, k) > 1 AND regexp_matches(ln.norm, '\S') AS gone FROM ln LEFT JOIN u ON u.norm = ln.norm LEFT JOIN comp ON comp.id = u.id),
per AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE gone) AS removed, string_agg(x, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS rest FROM place GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) > 0 THEN lines ELSE 0 END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed_lines, CASE WHEN text IS NOT NULL THEN md5(coalesce(rest, '')) END AS text_digest
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id""",
}
