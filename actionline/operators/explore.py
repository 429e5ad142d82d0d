"""Exploration results: statistics, boxed actions, safe names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def pass_stats(steps: DataFrame) -> DataFrame:
    """Trials, passed, pass_rate (0 without trials) of each recording, and its passed actions in order."""
    done = F.sort_array(F.collect_list(F.when(F.col("pass_flag"), F.struct("step_idx", F.concat("action", F.lit("["), F.col("element_id").cast("string"), F.lit("]")).alias("a")))))
    return steps.groupBy("id").agg(
        F.count("*").alias("trials"), F.count_if("pass_flag").alias("passed"), F.round(F.count_if("pass_flag") / F.count("*"), 6).alias("pass_rate"),
        F.array_join(F.transform(done, lambda x: x["a"]), " -> ").alias("actions"),
    )


def element_coverage(steps: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct elements (by a signature of text and id) that were tried and that passed."""
    count = F.approx_count_distinct if approx else F.count_distinct
    sign = F.md5(F.concat_ws(":", "element_text", F.col("element_id").cast("string")).cast("binary"))
    return steps.withColumn("__s", sign).groupBy("id").agg(count("__s").alias("tried"), count(F.when(F.col("pass_flag"), F.col("__s"))).alias("passed"))


#: Registers of a sketch, as a power of two, and the relative error that their number gives (one standard deviation).
SKETCH_LOG2 = 11
SKETCH_ERROR = 1.04 / (1 << SKETCH_LOG2) ** 0.5


def coverage_sketches(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """For each run and id a sketch of the elements tried and of those passed, to be stored with the run."""
    sign = F.xxhash64("element_text", F.col("element_id").cast("string"))
    sketch = lambda c: F.hll_sketch_agg(c, SKETCH_LOG2)
    return steps.groupBy(run, "id").agg(sketch(sign).alias("tried"), sketch(F.when(F.col("pass_flag"), sign)).alias("passed"))


def coverage_of_sketches(sketches: DataFrame) -> DataFrame:
    """About how many different elements were tried and passed over all runs, from their sketches alone.

    Sketches of a new run are united with the old ones; no run is read again. Estimates are off by SKETCH_ERROR
    of the count in one standard deviation."""
    count = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return sketches.groupBy("id").agg(count("tried"), count("passed"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts by outcome."""
    return results.groupBy("type").agg(F.count("*").alias("n"))


def first_results(results: DataFrame, kind: str = "success", order: str = "event_id", n: int = 20) -> DataFrame:
    """The first n results of a kind, a report of fixed length."""
    return results.where(F.col("type") == kind).orderBy(order).limit(n)


def failures(results: DataFrame) -> DataFrame:
    """Failed targets with their reasons."""
    return results.where("type = 'fail'").select("target", "reason")


def extract_boxed(column: str) -> Column:
    """The bodies of all \\boxed{...} in a text, empty ones left out."""
    found = F.regexp_extract_all(column, F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda x: x != "")


STRICT = r"^\s*(click)\s*\[([^\[\]]+)\]\s*$|^\s*(enter|select)\s*\[([^\[\]]+)\]\s*\[([^\[\]]*)\]\s*$"
TOLERANT = r"^\s*(click|enter|select|scroll)\s*\[([^\[\]]*)\]?\s*(?:\[([^\[\]]*)\]?)?\s*$"


def parse_actions(column: str, mode: str = "strict") -> Column:
    """array<struct<action, target, value>> of a sequence split at commas outside brackets.

    One action that can't be read makes the whole sequence null. Quotes around values go. strict: click
    with one argument, enter and select with two; tolerant: scroll too, and a last bracket may be open.
    """
    parts = F.filter(F.split(column, r",(?![^\[]*\])"), lambda p: F.trim(p) != "")
    clean = lambda v: F.regexp_replace(v, r"^[\"']+|[\"']+$", "")
    if mode == "strict":
        two = lambda p, i, j: F.concat(F.regexp_extract(p, STRICT, i), F.regexp_extract(p, STRICT, j))
        one = lambda p: F.struct(two(p, 1, 3).alias("action"), two(p, 2, 4).alias("target"), clean(F.regexp_extract(p, STRICT, 5)).alias("value"))
    else:
        one = lambda p: F.struct(F.regexp_extract(p, TOLERANT, 1).alias("action"), F.regexp_extract(p, TOLERANT, 2).alias("target"), clean(F.regexp_extract(p, TOLERANT, 3)).alias("value"))
    read = F.transform(parts, one)
    return F.when((F.size(read) > 0) & ~F.exists(read, lambda a: a["action"] == ""), read)


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("action", "target", "value")])))
def parse_nested_actions(text: pd.Series) -> pd.Series:
    """X5 for values that hold brackets themselves, matched by depth."""

    def one(x: str | None):
        out, depth, args, name, arg = [], 0, [], "", ""
        for c in f"{x or ''},":
            if c == "[":
                depth += 1
                arg += c if depth > 1 else ""
            elif c == "]" and depth:
                depth -= 1
                if depth:
                    arg += c
                else:
                    args.append(arg)
                    arg = ""
            elif depth:
                arg += c
            elif c == ",":
                if name.strip() or args:
                    name = name.strip()
                    if name not in ("click", "enter", "select", "scroll") or not args:
                        return None
                    out.append({"action": name, "target": args[0], "value": args[1].strip("\"'") if len(args) > 1 else ""})
                args, name = [], ""
            else:
                name += c
        return out or None

    return text.map(one)


def format_actions(actions: Column) -> Column:
    """act[id] or act[id][value], joined by ', '."""
    one = lambda a: F.concat(a["action"], F.lit("["), a["target"], F.lit("]"), F.when(a["value"] != "", F.concat(F.lit("["), a["value"], F.lit("]"))).otherwise(""))
    return F.array_join(F.transform(actions, one), ", ")


def safe_url_name(url: Column, n: int = 30) -> Column:
    """A file name of a url: other than word characters as _, cut to n, and eight digits of its md5."""
    return F.concat(F.substring(F.regexp_replace(url, r"(?U)\W+", "_"), 1, n), F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8))


def clean_label(label: Column) -> Column:
    """Letters, digits, _ and - of a label."""
    return F.regexp_replace(label, r"(?U)[^\p{IsAlphabetic}\p{IsDigit}_-]", "")


def sequence_names(labels: Column, most: int = 255) -> Column:
    """For each step the labels up to it, chained by _; plain step numbers for the whole sequence
    where any name would exceed ``most`` bytes."""
    names = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, F.lit(1), i + 1), "_"))
    numbers = F.transform(labels, lambda x, i: F.concat(F.lit("step_"), (i + 1).cast("string")))
    return F.when(F.exists(names, lambda n: F.octet_length(n) > most), numbers).otherwise(names)
