"""Line dedup by a log-template tree, in DataFrame operations only.

A line's path in the tree is its token count and its leading tokens, variable ones (with a digit) as
``<*>``. At the leaf the other tokens are cut into four stretches; the stretch seen most, place by
place, makes the leaf's template, and a line follows it if at most one stretch differs, which is then a
variable field. Templates that recur across documents are dropped, of which two levels count: lines that are
the same but for variable tokens, and lines of one leaf's template.

A template must recur in several independent texts. Equal texts are one, and so is a text with those that are copies of it: they share at least
three different recurring lines, which are more than 0.7 of either by characters. A line's first holder, by key, stands for its others, so that a text is compared
with the holder of most of its lines and no pairs are made. A page on which one banner or a short licence stands beside some text of its own is no copy of others like it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import materialise

DEPTH, STRETCHES = 4, 4
#: A copy shares at least so many different recurring lines with one other text, and more than such a share of both.
COPY_LINES, COPY_SHARE = 3, 0.7


def key60(x: F.Column) -> F.Column:
    """The first 60 bits of MD5, a key that other engines can form too."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long")


def parsed_lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(text_key, pos, size, leaf, s1..s4, same) of each line of at least ``min_tokens`` tokens."""
    rows = docs.where("text is not null").select("text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ ]*[0-9][^ ]*", "<*>")).otherwise(F.col("line"))
    tokens = F.filter(F.split(F.trim(masked), " "), lambda t: t != "")
    rows = rows.select("text_key", "pos", tokens.alias("t"), F.length("line").alias("size")).where(F.size("t") >= min_tokens)
    rest = F.greatest(F.size("t") - DEPTH, F.lit(0))
    step = F.greatest(F.ceil(rest / STRETCHES), F.lit(1)).cast("int")
    stretch = lambda k: key60(F.array_join(F.slice("t", DEPTH + 1 + k * step, step), " "))
    leaf = key60(F.concat_ws(" ", F.size("t").cast("string"), F.array_join(F.slice("t", 1, DEPTH), " ")))
    rows = rows.select("text_key", "pos", "size", leaf.alias("leaf"), *[stretch(k).alias(f"s{k + 1}") for k in range(STRETCHES)])
    return rows.withColumn("same", key60(F.concat_ws(",", "leaf", *[f"s{k + 1}" for k in range(STRETCHES)])))


def copies(held: DataFrame, whole: DataFrame) -> DataFrame:
    """(text_key, root) of texts that are copies of another one.

    ``held``: (same, text_key, size) of recurring lines, ``whole``: (text_key, whole) of all lines. A root is the first holder of over half of its own lines, so it is no copy itself.
    """
    first = held.groupBy("same").agg(F.min("text_key").alias("of"))
    shared = held.join(first, "same").where("text_key <> of").groupBy("text_key", "of").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    best = shared.where(F.col("n") >= COPY_LINES).groupBy("text_key").agg(F.max(F.struct("size", "of")).alias("b")).select("text_key", "b.of", "b.size")
    met = best.join(whole, "text_key").join(whole.select(F.col("text_key").alias("of"), F.col("whole").alias("of_whole")), "of")
    return met.where(F.col("size") > COPY_SHARE * F.greatest("whole", "of_whole")).select("text_key", F.col("of").alias("root"))


def independent(per_text: DataFrame, key: str, copied: DataFrame, min_docs: int) -> DataFrame:
    """The ``key`` values of (key, text_key) that at least ``min_docs`` independent texts hold; those of one root in ``copied`` (text_key, root) count as one."""
    roots = per_text.join(copied, "text_key", "left").select(key, F.coalesce("root", "text_key").alias("root")).distinct()
    return roots.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(key)


def drop_templates(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, keep_columns: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of ``docs``; with ``keep_columns`` its own columns, text cut and n_chars set.

    All lines of templates that recur in ``min_docs`` independent texts go; lines of fewer than ``min_tokens`` tokens stay. A null
    text gives no lines and stays null; an empty one has one empty line. Equal texts, repeated rows among them, are one text and have the
    same lines cut; each row is returned. Very long texts are read whole. Ties for a leaf's commonest stretch go to the greater key.
    Lines are split at ``\\n``, tokens at spaces. An empty table gives no rows. Columns whose names clash with those used inside are
    kept apart from them.
    """
    row = F.struct(*docs.columns) if keep_columns else F.struct("text")
    own = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key60(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    text = F.col("row")["text"].cast("string")
    # parsed once: all that follows reads these numbers, not the texts
    lines = materialise(parsed_lines(own.select("text_key", text.alias("text")), min_tokens), "lines")
    stretches = [f"s{k + 1}" for k in range(STRETCHES)]
    # exact but for variable tokens; ``same`` stands for leaf and stretches
    per_text = materialise(lines.groupBy("same", "text_key").agg(F.sum("size").alias("size")), "lines-of-texts")
    often = per_text.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("same")
    held = materialise(per_text.join(often, "same", "left_semi"), "frequent-lines")
    whole = per_text.groupBy("text_key").agg(F.sum("size").alias("whole"))
    copied = materialise(copies(held, whole), "copied-texts")
    gone = lines.select("same", "text_key", "pos").join(independent(held, "same", copied, min_docs), "same", "left_semi").drop("same")
    # leaves with several different lines: the commonest of each stretch, by lines, makes the template
    wide = lines.groupBy("leaf").agg(F.min("same").alias("a"), F.max("same").alias("b"), F.count("*").alias("n")).where(f"a <> b and n >= {min_docs}").select("leaf")
    mixed = materialise(lines.join(wide, "leaf", "left_semi").select("leaf", *stretches, "text_key", "pos"), "mixed-leaves")
    kinds = mixed.groupBy("leaf", *stretches).agg(F.count("*").alias("n"))
    votes = kinds.select("leaf", "n", F.posexplode(F.array(*stretches)).alias("k", "s")).groupBy("leaf", "k", "s").agg(F.sum("n").alias("n"))
    best = votes.groupBy("leaf").pivot("k", list(range(STRETCHES))).agg(F.max_by("s", F.struct("n", "s")))
    best = best.select("leaf", *[F.col(str(k)).alias(f"m{k + 1}") for k in range(STRETCHES)])
    followed = mixed.join(best, "leaf").where(sum((F.col(f"s{k}") == F.col(f"m{k}")).cast("int") for k in range(1, STRETCHES + 1)) >= STRETCHES - 1)
    followed = materialise(followed.select("leaf", "text_key", "pos"), "followed")
    general = independent(followed.select("leaf", "text_key").distinct(), "leaf", copied, min_docs)
    gone = gone.unionByName(followed.join(general, "leaf", "left_semi").select("text_key", "pos"))
    dropped = gone.groupBy("text_key").agg(F.collect_set("pos").alias("gone"))
    joined = own.join(dropped.withColumnRenamed("text_key", "k"), F.col("text_key") == F.col("k"), "left").select("row", "doc_id", "gone", F.split(text, "\n").alias("parts"))
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n"))
    if keep_columns:
        out = {c: F.col("row")[c] for c in docs.columns} | {"text": kept} | ({"n_chars": F.length(kept).cast("long")} if "n_chars" in docs.columns else {})
        return joined.select(*[v.alias(c) for c, v in out.items()])
    return joined.select("doc_id", F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


_KEY = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_SAME = " + ".join(f"(s{k} = m{k})::INT" for k in range(1, STRETCHES + 1))
_S = ", ".join(f"s{k}" for k in range(1, STRETCHES + 1))
SQL = f"""
WITH own AS (SELECT doc_id, text, {_KEY.format("coalesce(text, '')")} AS text_key, string_split(text, chr(10)) AS l FROM documents),
raw AS (SELECT text_key, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM own WHERE text IS NOT NULL),
tok AS (SELECT text_key, pos, length(line) AS size, list_filter(string_split(trim(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g')), ' '), lambda x: x <> '') AS t FROM raw),
cut AS (SELECT *, greatest(ceil(greatest(len(t) - {DEPTH}, 0) / {STRETCHES}.0), 1)::BIGINT AS step FROM tok WHERE len(t) >= 3),
lines AS MATERIALIZED (SELECT text_key, pos, size, {_KEY.format(f"len(t)::VARCHAR || ' ' || array_to_string(t[1:{DEPTH}], ' ')")} AS leaf,
          {", ".join(_KEY.format(f"array_to_string(t[{DEPTH} + 1 + {k} * step:{DEPTH} + {k + 1} * step], ' ')") + f" AS s{k + 1}" for k in range(STRETCHES))} FROM cut),
often AS (SELECT leaf, {_S} FROM lines GROUP BY ALL HAVING count(DISTINCT text_key) >= 3),
held AS MATERIALIZED (SELECT leaf, {_S}, text_key, sum(size) AS size FROM lines SEMI JOIN often USING (leaf, {_S}) GROUP BY ALL),
firsts AS (SELECT leaf, {_S}, min(text_key) AS of FROM held GROUP BY ALL),
shared AS (SELECT text_key, of, sum(size) AS size FROM held JOIN firsts USING (leaf, {_S}) WHERE text_key <> of GROUP BY ALL HAVING count(*) >= {COPY_LINES}),
wholes AS (SELECT text_key, sum(size) AS whole FROM lines GROUP BY 1),
copied AS MATERIALIZED (SELECT s.text_key, s.of AS root FROM (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY size DESC, of DESC) = 1) s
          JOIN wholes w ON w.text_key = s.text_key JOIN wholes o ON o.text_key = s.of WHERE s.size > {COPY_SHARE} * greatest(w.whole, o.whole)),
exact AS (SELECT leaf, {_S} FROM held LEFT JOIN copied USING (text_key) GROUP BY ALL HAVING count(DISTINCT coalesce(root, text_key)) >= 3),
kinds AS (SELECT leaf, {_S}, count(*) AS n FROM lines GROUP BY ALL),
wide AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1 AND sum(n) >= 3),
votes AS (SELECT leaf, k, s, sum(n) AS n FROM (SELECT leaf, n, unnest([1, 2, 3, 4]) AS k, unnest([{_S}]) AS s FROM kinds SEMI JOIN wide USING (leaf)) GROUP BY ALL),
top AS (SELECT leaf, k, s FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, k ORDER BY n DESC, s DESC) = 1),
best AS (SELECT leaf, {", ".join(f"max(s) FILTER (k = {k}) AS m{k}" for k in range(1, STRETCHES + 1))} FROM top GROUP BY leaf),
followed AS MATERIALIZED (SELECT leaf, text_key, pos FROM lines JOIN best USING (leaf) WHERE {_SAME} >= {STRETCHES - 1}),
general AS (SELECT leaf FROM followed LEFT JOIN copied USING (text_key) GROUP BY leaf HAVING count(DISTINCT coalesce(root, text_key)) >= 3),
gone AS (SELECT text_key, list(DISTINCT pos) AS gone FROM (
           SELECT text_key, pos FROM lines SEMI JOIN exact USING (leaf, {_S})
           UNION SELECT text_key, pos FROM followed SEMI JOIN general USING (leaf)) GROUP BY ALL)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS kept_text
FROM own LEFT JOIN gone USING (text_key)
"""
