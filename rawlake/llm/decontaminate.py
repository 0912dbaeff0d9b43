"""Benchmark decontamination: windows of templates with typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rawlake.llm.common import hash_pair, stage, text_of, words_of
from rawlake.session import attach

# Placeholders are private-use characters, which take the place of whole words.
NUMBER, NAME, UNIT = "", "", ""
SLOTS = f"[{NUMBER}{NAME}{UNIT}]"
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr ms hz khz mhz ghz w kw mw v a pa kpa bar k kb mb gb tb "
    "percent dollars dollar euros euro pounds cents meters metres kilometers kilometres miles feet inches grams kilograms "
    "liters litres seconds minutes hours days weeks months years degrees"
).split()
ROW = ["__leak_row1", "__leak_row2"]
# Hashes of benchmark items of at most so many stored bytes are sent to all tasks.
ITEM_BYTES = 16 << 20


def template(words: Column) -> Column:
    """Words with numbers, names and units as placeholders, the rest in lower case without punctuation.

    A word with a digit is a number. A capitalised word is a name unless a sentence starts
    with it. A unit is a known unit word after a number. The list stays as long as ``words``.
    """
    text = F.array_join(words, " ")
    text = F.regexp_replace(text, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", NUMBER)
    text = F.regexp_replace(text, f"{NUMBER} (?:{'|'.join(UNITS)}|[%°€$£])(?=[.,;:!?)]*(?: |$))", f"{NUMBER} {UNIT}")
    text = F.regexp_replace(text, "\\p{Lu}(?<=[^ .!?:] \\p{Lu})[^ ]*", NAME)
    text = F.lower(F.regexp_replace(text, "\\p{P}+", ""))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.split(text, " "))


def plain_words(words: Column) -> Column:
    """Words in lower case without punctuation at their ends; words of punctuation only are left out."""
    text = F.regexp_replace(F.lower(F.array_join(words, " ")), "(?<![^ ])\\p{P}+|\\p{P}+(?![^ ])", "")
    return F.filter(F.split(text, " "), lambda w: w != "")


def blocks(tokens: Column, width: int) -> Column:
    """Hashes of the parts of ``width`` tokens that follow each other from the first token on."""
    each = F.transform(F.sequence(F.lit(0), F.size(tokens) - width, F.lit(width)), lambda i: F.xxhash64(F.slice(tokens, i + 1, width)))
    return F.when(F.size(tokens) >= width, each).otherwise(F.array().cast("array<bigint>"))


def bare_words(text: Column) -> Column:
    """Words in lower case without any punctuation; words of punctuation only are left out.

    Where ``plain_words`` are equal these are too, so that they find all texts worth a
    closer look, at a fraction of the cost.
    """
    return words_of(F.regexp_replace(F.lower(text), "\\p{P}+", ""))


def quotes(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """(id, r1, r2, item, item_row) of documents (id, r1, r2, text) with ``run`` equal words of an item, or all words of a shorter one.

    Such a run holds a whole block of (run + 1) / 2 words wherever it starts, so that blocks,
    which follow each other in documents and start at every word of items, find the
    documents whose runs are then compared.
    """
    runs = stage(items.select("item", "item_row", "text", plain_words(words_of(F.col("text"))).alias("tokens")).distinct())
    runs = runs.withColumn("run", F.least(F.size("tokens"), F.lit(run))).where("run > 0")
    sizes = sorted(r["run"] for r in runs.select("run").distinct().collect())  # at most ``run`` numbers
    halves = sorted({(n + 1) // 2 for n in sizes})

    def hashed(sizes: list[int], each) -> Column:
        def named(n: int) -> Column:
            return F.transform(each(F.col("tokens"), n), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))

        parts = [named(n) for n in sizes]
        return F.inline(F.flatten(F.array(*parts)) if parts else F.array().cast("array<struct<n:int,h:bigint>>"))

    def every(tokens: Column, n: int) -> Column:
        return F.transform(windows(tokens, n), lambda x: x["h"])

    half = F.floor((F.col("run") + 1) / 2).cast("int")
    theirs = runs.withColumn("tokens", bare_words(F.col("text"))).select("item_row", "run", half.alias("half"), hashed(halves, every))
    theirs = stage(theirs.where("n = half").select("n", "h").distinct())
    ours = docs.select("r1", "r2", bare_words(F.col("text")).alias("tokens")).select("r1", "r2", hashed(halves, blocks))
    near = stage(attach(ours, theirs, ["n", "h"], "inner", spread=["r1"], limit=ITEM_BYTES).select("r1", "r2").distinct())
    again = docs.join(near, ["r1", "r2"], "left_semi").distinct()
    again = again.select("id", "r1", "r2", plain_words(words_of(F.col("text"))).alias("tokens")).select("id", "r1", "r2", hashed(sizes, every))
    theirs = stage(runs.select("item", "item_row", "run", hashed(sizes, every)).where("n = run").select("n", "h", "item", "item_row").distinct())
    equal = attach(again, theirs, ["n", "h"], "inner", spread=["r1"], limit=ITEM_BYTES)
    return stage(equal.select("id", "r1", "r2", "item", "item_row").distinct())


def windows(tokens: Column, width: int) -> Column:
    """(hash, start) of every window of ``width`` tokens."""
    last = F.size(tokens) - width
    each = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.slice(tokens, i + 1, width)).alias("h"), i.alias("at"))
    )
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    row = F.xxhash64(F.col(item_col), text_of(text_col)).alias("item_row")
    return benchmark.select(F.col(item_col).alias("item"), row, text_of(text_col).alias("text"))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int, literals: int) -> DataFrame:
    """Windows of benchmark items that hold at least ``literals`` words besides slots."""
    tokens = item_words(benchmark, item_col, text_col).withColumn("words", words_of(F.col("text")))
    tokens = tokens.withColumn("tokens", template(F.col("words")))
    each = tokens.select("item", "item_row", "words", "tokens", F.inline(windows(F.col("tokens"), width)))
    cut = F.slice("tokens", F.col("at") + 1, width)
    literal = F.size(F.filter(cut, lambda t: (t != "") & ~F.rlike(t, F.lit(SLOTS))))
    return each.where(literal >= literals).select(
        "item", "item_row", "h", "at", F.size("tokens").alias("item_words"), slots(F.col("words"), F.col("tokens"), F.col("at"), width).alias("slots")
    )


def slots(words: Column, tokens: Column, at: Column, width: int) -> Column:
    """(place in the window, original word) of the window's slots."""
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.rlike(F.get(tokens, at + i), F.lit(SLOTS)))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.get(words, at + i).alias("word")))


def occurrences(both: DataFrame, by: list[str]) -> DataFrame:
    """Matches of windows with the ``occurrence`` that they may belong to, from the places in document and item.

    A copy keeps its distance (place in the document less place in the item) but for words
    put in or left out. Occurrences are single distances, spans of half an item's length of
    them (each distance is in two), and all matches of the document. In a span a window of
    either text counts for the distance that most matches have, so that windows which an
    item repeats do not pair across.
    """
    both = both.withColumn("far", F.col("at") - F.col("item_at"))
    wide = F.greatest(F.floor(F.col("item_words") / 2), F.lit(2))
    span = lambda shift: F.floor((F.col("far") + shift) / wide).cast("bigint")
    kinds = [("all", F.lit(0).cast("bigint")), ("one", F.col("far").cast("bigint")), ("even", span(0)), ("odd", span(F.floor(wide / 2)))]
    each = both.withColumn("occurrence", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("number")) for k, v in kinds])))
    alone = F.col("occurrence.kind").isin("all", "one")
    spans = each.where(~alone)
    group = [*by, "occurrence"]
    spans = spans.withColumn("support", F.count(F.lit(1)).over(W.partitionBy(*group, "far")))
    best = F.struct(F.col("support"), -F.abs("far"), F.col("far"))
    spans = spans.withColumn("best", best).withColumn("of_doc", F.max("best").over(W.partitionBy(*group, "at")))
    spans = spans.withColumn("of_item", F.max("best").over(W.partitionBy(*group, "item_at")))
    spans = spans.where((F.col("best") == F.col("of_doc")) & (F.col("best") == F.col("of_item")))
    return each.where(alone).unionByName(spans.select(*each.columns))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    literals: int = 3,
    share: float = 0.5,
    run: int = 13,
) -> DataFrame:
    """Documents that hold benchmark items, literally or with other numbers, names and units.

    Both texts become templates. Windows of ``width`` words with at least ``literals``
    ordinary words are joined by hash; a pair counts if at least ``share`` of the item's
    distinct windows are in the document and either so many match with the same slot words,
    or so many are in one occurrence (see ``occurrences``) whose slots are consistent: each
    of the item's slot words stands for one word of the document, and each of the document's
    for one of the item's. ``run`` equal words one after another, but for case and
    punctuation at their ends, or all words of a shorter item, are a literal leak whatever
    the share and the kinds of words.

    Returns a row per document and item: id, item, ``n_windows`` of the item, ``n_matched``,
    ``n_literal`` (matched with equal slots), ``n_slots`` (different words in the item's
    matched slots of the best occurrence), ``consistent`` (of that occurrence) and ``kind`` (literal or reparameterised). Null and empty
    texts, and those of punctuation only, match nothing; items without such a window have the count 0 and match as runs of
    equal words only. Repeated rows of one id and text
    give one row; null ids give rows with a null id. Other columns are not read.
    """
    items = stage(item_windows(benchmark, item_col, item_text_col, width, literals))
    sizes = items.groupBy("item", "item_row").agg(F.count_distinct("h").alias("n_windows"))
    row = hash_pair(F.col(id_col), text_of(text_col))
    texts = docs.select(F.col(id_col).alias("id"), row[0].alias("r1"), row[1].alias("r2"), text_of(text_col).alias("text"))
    keys = ["id", "r1", "r2", "item", "item_row"]

    tokens = texts.select("id", "r1", "r2", template(words_of(F.col("text"))).alias("tokens"))
    each = tokens.select("id", "r1", "r2", F.inline(windows(F.col("tokens"), width)))
    # windows meet the items where they are made, unless the benchmark is too large to be sent there
    hashes = stage(items.select("item", "item_row", "h").distinct())
    hits = attach(each.select("id", "r1", "r2", "h"), hashes, ["h"], "inner", spread=["r1"], limit=ITEM_BYTES)
    found = hits.select(*keys, "h").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"))
    equal = quotes(texts, item_words(benchmark, item_col, item_text_col), run).withColumn("quoted", F.lit(True))
    equal = equal.select(*keys, F.lit(0).cast("bigint").alias("n_matched"), "quoted")
    found = found.withColumn("quoted", F.lit(False)).unionByName(equal)
    found = found.groupBy(*keys).agg(F.max("n_matched").alias("n_matched"), F.max("quoted").alias("quoted"))
    found = found.join(sizes, ["item", "item_row"], "left").na.fill(0, ["n_windows"])
    found = stage(found.where((F.col("n_matched") >= share * F.col("n_windows")) | F.col("quoted")))

    # the few candidates again, with their slots
    pairs = found.select("r1", "r2", "item_row").distinct()
    again = texts.drop("id").join(pairs.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    again = again.withColumn("words", words_of(F.col("text")))
    again = again.withColumn("tokens", template(F.col("words")))
    again = again.select("r1", "r2", "words", "tokens", F.inline(windows(F.col("tokens"), width)))
    mine = again.join(items.select("h").distinct(), "h", "left_semi")
    mine = mine.select("r1", "r2", "h", "at", slots(F.col("words"), F.col("tokens"), F.col("at"), width).alias("mine"))
    theirs = items.select("item_row", "h", F.col("at").alias("item_at"), "item_words", "slots").distinct()
    by = ["r1", "r2", "item_row"]
    both = stage(mine.join(theirs, "h").join(pairs, by, "left_semi"))
    literal = both.where(F.col("mine") == F.col("slots")).groupBy(*by).agg(F.count_distinct("h").alias("n_literal"))
    each = occurrences(both, by)
    group = [*by, "occurrence"]
    covers = each.select(*group, "h").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n_here"))
    values = each.select(*group, F.explode(F.arrays_zip("slots", "mine")).alias("z"))
    values = values.select(*group, F.col("z.slots.word").alias("theirs"), F.col("z.mine.word").alias("ours")).distinct()
    used = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("theirs").alias("n_slots"), F.count_distinct("ours").alias("n_ours")
    )
    tried = covers.join(used, group, "left").na.fill(0, ["n_pairs", "n_slots", "n_ours"])
    same = (F.col("n_pairs") == F.col("n_slots")) & (F.col("n_pairs") == F.col("n_ours"))
    tried = tried.join(found.select("item_row", "n_windows").distinct(), "item_row")
    covered = same & (F.col("n_here") >= share * F.col("n_windows"))
    best = F.max(F.struct(covered.alias("consistent"), F.col("n_here"), F.col("n_slots"))).alias("best")
    tried = tried.groupBy(*by).agg(best).select(*by, "best.consistent", "best.n_slots")
    checked = found.join(literal, by, "left").join(tried, by, "left").na.fill(0, ["n_literal", "n_slots"]).na.fill(False, ["consistent"])
    plain = F.col("quoted") | (F.col("n_literal") >= share * F.col("n_windows"))
    checked = checked.withColumn("kind", F.when(plain, "literal").otherwise("reparameterised")).where(plain | F.col("consistent"))
    return checked.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_matched", "n_literal", "n_slots", "consistent", "kind", "r1", "r2"
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = leaks(docs, benchmark, id_col, text_col, **how).select(F.col("r1").alias(ROW[0]), F.col("r2").alias(ROW[1])).distinct()
    row = hash_pair(F.col(id_col), text_of(text_col))
    return docs.withColumns(dict(zip(ROW, row, strict=True))).join(bad, ROW, "left_anti").drop(*ROW)
