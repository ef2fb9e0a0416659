"""Person names mined from transcripts: n-grams that begin with a surname, counted per job, then weighed against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def mine_names(rows: DataFrame, compound: dict[str, str], surnames: dict[str, str], given: dict[str, str], ambiguous: list[str] = (), words: DataFrame | None = None, tags: DataFrame | None = None, least: int = 3, most: int = 40) -> DataFrame:
    """job_id, source, target, count, auto, place (order of the result) of names in rows (job_id, text).

    `words` (word) are dictionary words that are no names; `tags` (job_id, word) are words that a tagger took for names."""
    w2 = F.substring("gram", 1, 2).isin(list(compound) or [""])
    # One row for each place at which a surname stands, with up to four characters from there. Equal ones are counted before they are
    # exchanged; the counts of shorter grams are sums over them, since each begins at such a place.
    head = lambda i: F.substring(F.col("text"), i, F.lit(1)).isin(list(surnames) or [""]) | F.substring(F.col("text"), i, F.lit(2)).isin(list(compound) or [""])
    places = F.filter(F.sequence(F.lit(1), F.length("text") - 1), head)
    windows = rows.filter(F.length("text") > 1).select("job_id", F.explode(F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(4)))).alias("window"))
    windows = windows.groupBy("job_id", "window").agg(F.count("*").alias("n"))
    sizes = F.filter(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: k <= F.length("window"))
    grams = windows.select("job_id", "n", F.explode(F.transform(sizes, lambda k: F.substring(F.col("window"), F.lit(1), k))).alias("gram")).filter(~F.contains("gram", F.lit("\n")))
    counts = grams.groupBy("job_id", "gram").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("target", X.reading(F.col("gram"), compound, surnames, given)).filter(F.col("target").isNotNull())
    plain = counts if words is None else counts.join(words.select(F.col("word").alias("gram")), "gram", "left_anti")
    found = plain.filter((F.col("count") >= least) & (w2 | ((F.length("gram") != 4) & ~F.substring("gram", 1, 1).isin(list(ambiguous) or [""]))))
    if tags is not None:
        named = tags.select("job_id", F.col("word").alias("gram")).distinct()
        found = found.unionByName(counts.filter("count >= 2").join(named, ["job_id", "gram"], "left_semi")).distinct()
    c = found.select("job_id", "gram", "count", "target")
    # a short form that its longer forms explain goes
    longer = c.select("job_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("gram") - 1, F.lit(2))), lambda k: F.when(k < F.length("gram"), F.substring(F.col("gram"), F.lit(1), k)))).alias("short"), "count").filter("short is not null")
    inside = longer.groupBy("job_id", F.col("short").alias("gram")).agg(F.sum("count").alias("taken"))
    c = c.join(inside, ["job_id", "gram"], "left").filter(F.col("taken").isNull() | (F.col("count") - F.col("taken") >= least)).drop("taken")
    # a long form that its prefix dwarfs is the name and another word
    heads = c.filter(F.length("gram") == 2).select("job_id", F.col("gram").alias("head"), F.col("count").alias("head_count"))
    c = c.withColumn("head", F.when(F.length("gram") == 3, F.substring("gram", 1, 2))).join(heads, ["job_id", "head"], "left").filter(F.col("head_count").isNull() | (F.col("head_count") < 4 * F.col("count"))).drop("head", "head_count")
    top = c.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("count"), "gram"))).filter(F.col("_n") <= most)
    # given names that also stand alone
    alias = top.withColumn("given", F.when(w2, F.substring("gram", 3, 4)).otherwise(F.substring("gram", 2, 4))).filter(F.length("given") >= 2)
    pairs = alias.groupBy("job_id").agg(F.collect_list(F.struct("gram", "given", F.col("_n").alias("_rank"))).alias("_pairs"))  # `most` of a job at most
    times = lambda part: F.floor((F.length("text") - F.length(F.replace(F.col("text"), part, F.lit("")))) / F.length(part)).cast("long")
    here = F.filter("_pairs", lambda p: F.contains(F.col("text"), p["given"]))
    met = rows.select("job_id", "text").join(pairs, "job_id").select("job_id", F.inline(F.transform(here, lambda p: F.struct(p["gram"].alias("gram"), p["given"].alias("given"), p["_rank"].alias("_rank"), (times(p["given"]) - times(p["gram"])).alias("n")))))
    seen = met.groupBy("job_id", "gram", "given", "_rank").agg(F.sum("n").alias("count"))
    of_given = X.literal_map(given)
    spelled = F.transform(F.filter(F.split("given", ""), lambda x: x != ""), lambda x: F.try_element_at(of_given, x))
    alone = seen.filter("count >= 2").withColumn("_parts", spelled).filter(~F.exists("_parts", lambda x: x.isNull()))
    alone = alone if words is None else alone.join(words.select(F.col("word").alias("given")), "given", "left_anti")
    alone = alone.join(top.select("job_id", F.col("gram").alias("given")), ["job_id", "given"], "left_anti")
    first = alone.withColumn("_k", F.row_number().over(Window.partitionBy("job_id", "given").orderBy("_rank"))).filter("_k = 1")
    both = top.select("job_id", F.col("gram").alias("source"), "target", "count", F.col("_n").alias("_at")).unionByName(first.select("job_id", F.col("given").alias("source"), F.array_join("_parts", " ").alias("target"), "count", (F.col("_rank") + 1000).alias("_at")))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(F.length("source")), F.desc("count"), "_at"))
    return both.select("job_id", "source", "target", F.col("count").cast("long"), F.lit(True).alias("auto"), place.alias("place"))
