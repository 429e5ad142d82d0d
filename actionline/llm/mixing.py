"""Operator 5: mixing sources to target weights by a tree of budgets (domain, language, source)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actionline.llm.common import table, written

LEVELS = ["domain", "lang", "source"]
#: Production parameters: the domain of each source (others: forum), and whole-number weights (others: 10).
DOMAINS = {"src0": "web", "src1": "books", "src2": "books", "src3": "books", "src4": "reference", "src5": "reference", "src6": "reference"}
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"web": 30, "books": 30, "reference": 20, "forum": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
OTHER = 10
#: The budget as a percentage of all tokens; how often a document may be used; the seed of the epochs.
PERCENT, EPOCHS, SEED = 80, 2, 5
WORD = r"[^\x20\x09-\x0D]+"


def _mapped(column: str, values: Mapping[str, object], other: object) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def tree(docs: DataFrame, domains: Mapping[str, str] = DOMAINS) -> DataFrame:
    """row (all columns of docs, so that none can clash), domain, lang, source (null: empty), id and n, the words of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.select(F.struct("*").alias("row"), text("lang").alias("lang"), text("source").alias("source"), text("doc_id").alias("id"), words.alias("n"))
    return out.withColumn("domain", _mapped("source", domains, "forum"))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, w, cap, budget of the parent) with own: min(cap, rate * w), for one rate per parent.

    In the order of cap / w, a node is full as long as the rest of the budget, dealt by weight among it
    and those after it, covers its cap. Whole numbers throughout; a part of a token is never dealt.
    """
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("w").over(after))
    out = out.withColumn("full", F.expr("(budget - taken) * w >= cap * weights"))
    all_of = Window.partitionBy(*parents)
    out = out.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_of))
    return out.withColumn("own", F.expr("CASE WHEN full THEN cap ELSE greatest(0, rest * w div nullif(open, 0)) END")).drop("taken", "weights", "full", "rest", "open")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, supply) with own, the tokens each may give.

    A node takes no more than its subtree holds, epochs times over. What a node can't take goes to its
    siblings by weight; only what all siblings can't take is missing in their parent, whose own siblings
    then get it, as each level is filled under the caps of whole subtrees. One row a leaf, few by nature;
    windows are per parent, and the root's children are domains.
    """
    out = leaves.withColumn("cap", F.col("supply") * epochs)
    total = leaves.agg((F.coalesce(F.sum("supply"), F.lit(0)) * percent / 100).cast("long").alias("own")).withColumn("root", F.lit(1))
    up, parents = total, ["root"]
    out = out.withColumn("root", F.lit(1))
    for level in LEVELS:
        nodes = out.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("w", _mapped(level, weights.get(level, {}), OTHER).cast("long"))
        nodes = _fill(nodes.join(up.select(*parents, F.col("own").alias("budget")), parents), parents, level)
        parents = [*parents, level]
        up = nodes.select(*parents, "own")
    return leaves.join(up.drop("root"), LEVELS)


def chosen(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, domains: Mapping[str, str] = DOMAINS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mixture takes, each as row, with copies, how often, beside the columns of tree().

    A leaf whose budget is e times its supply and some more uses every document e times, and those of the
    next epoch's order as far as their words fit the remainder; that order is by md5(seed:epoch:doc_id).
    Documents with equal doc_id stand or fall together. Null language, source or doc_id count as empty
    strings; null and empty texts have no words and go with the prefix. Empty table: empty result. Where
    the order of a leaf is cut is found by prefix sums over two digits of the hash after another: a leaf
    gives 256 sums a step, and only the rows that share four digits with the cut, one in 65,536, are put in
    order, so no task holds a whole leaf. Documents are then filtered where they are: no text is shuffled.
    """
    rows = tree(docs, domains)
    narrow = written(rows.select(*LEVELS, "id", "n"), "words")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("supply"))
    plan = budgets(leaves, weights, percent, epochs)
    plan = written(plan.withColumn("whole", F.expr("CASE WHEN supply > 0 THEN own div supply ELSE 0 END")).withColumn("more", F.expr("own - whole * supply")), "plan")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), "id").cast("binary"))
    edge = plan.select(*LEVELS, "whole", F.lit("").alias("prefix"), F.col("more").alias("left"))
    near = narrow.join(edge, LEVELS).withColumn("h", order)
    for digits in (2, 4):
        sums = near.groupBy(*LEVELS, F.substring("h", 1, digits).alias("bucket")).agg(F.sum("n").alias("sum"), F.first("whole").alias("whole"), F.first("left").alias("left"))
        sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("sum"))
        # the first bucket that doesn't fit as a whole, and what is left for its own rows
        first = sums.where("before + sum > left").groupBy(*LEVELS).agg(F.min(F.struct("bucket", "whole", (F.col("left") - F.col("before")).alias("left"))).alias("at"))
        edge = written(first.select(*LEVELS, "at.whole", F.col("at.bucket").alias("prefix"), "at.left"), "edge")
        near = narrow.join(edge, LEVELS).withColumn("h", order).where(F.col("h").startswith(F.col("prefix")))
    inner = near.withColumn("sum", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, 0)))
    last = inner.where("sum <= left").groupBy(*LEVELS).agg(F.max("h").alias("last"))
    cut = edge.join(last, LEVELS, "left").select(*LEVELS, F.coalesce("last", "prefix").alias("cut"))
    plan = written(plan.join(cut, LEVELS, "left").select(*LEVELS, "whole", "cut"), "plan")  # a small table: read again, its size is known
    taken = F.col("cut").isNull() | (order <= F.col("cut"))
    return rows.join(plan, LEVELS).withColumn("copies", F.col("whole") + taken.cast("long")).where("copies > 0").drop("whole", "cut")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The columns of docs, whatever their names; a row for each use of a document. Other cases as in chosen()."""
    use = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("use")
    return chosen(docs, **parameters).select("row", use).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that the mixture takes. Null lang, source or doc_id: as empty strings. Null and
    empty texts: no words, taken with the prefix of their leaf. Very long texts: taken only where they fit as a
    whole. Ties (equal doc_id): stand or fall together; repeated rows: each counts. Other columns, clashing
    names among them, are ignored. Empty table: empty result."""
    out = chosen(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "domain", "lang", "source", F.col("n").alias("n_tokens"), "copies")


def _case(column: str, values: Mapping[str, object], other: object) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {show(other)} END" if values else show(other)


def _fill_sql(level: str, parents: str, nodes: str) -> str:
    """The rows of _fill for one level, written for the SQL twin."""
    return f"""SELECT *, CASE WHEN ok THEN cap ELSE greatest(0, (budget - sum(CASE WHEN ok THEN cap ELSE 0 END) OVER (PARTITION BY {parents})) * w // nullif(sum(CASE WHEN ok THEN 0 ELSE w END) OVER (PARTITION BY {parents}), 0)) END AS own
  FROM (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
      >= cap * sum(w) OVER (PARTITION BY {parents} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM ({nodes}))"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_case("coalesce(source, '')", DOMAINS, "forum")} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS supply, sum(n) * {EPOCHS} AS cap FROM d GROUP BY ALL),
l1 AS ({_fill_sql("domain", "1", f"SELECT domain, sum(cap) AS cap, {_case('domain', WEIGHTS['domain'], OTHER)} AS w, (SELECT sum(supply) * {PERCENT} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain")}),
l2 AS ({_fill_sql("lang", "domain", f"SELECT domain, lang, sum(leaf.cap) AS cap, {_case('lang', WEIGHTS['lang'], OTHER)} AS w, any_value(l1.own) AS budget FROM leaf JOIN l1 USING (domain) GROUP BY domain, lang")}),
l3 AS ({_fill_sql("source", "domain, lang", f"SELECT domain, lang, source, sum(leaf.cap) AS cap, {_case('source', WEIGHTS['source'], OTHER)} AS w, any_value(l2.own) AS budget FROM leaf JOIN l2 USING (domain, lang) GROUP BY domain, lang, source")}),
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN own // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN own % supply ELSE own END AS more
  FROM l3 JOIN leaf USING (domain, lang, source)),
o AS (SELECT doc_id, domain, lang, source, n, whole, more, sum(n) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat('{SEED}:', whole + 1, ':', coalesce(doc_id::VARCHAR, ''))) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n AS n_tokens, (whole + CASE WHEN upto <= more THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o WHERE whole + CASE WHEN upto <= more THEN 1 ELSE 0 END > 0
"""
