"""Which names of a long list may stand in which texts: an inverted index by the rarest word.

The words of the texts are counted (in how many each stands); a name goes under its
rarest word, and one with a word that no text has is left out: mostly by a bit table of the
texts' words, where the name is, before it is cut into words or shuffled. So a million
names that begin with "The" meet only the texts that hold their other words. Only words
that may be such keys leave their text (by a bit table too), and only texts with a hit
meet their names in a join: by a hash of the text, so that rows of a null or repeated id
get the names of their own text. Bit tables grow with what they stand for, up to 16 MB;
what one lets through by chance is sorted out by the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.scratch import written

# A bit table has BITS_EACH bits for each value at least, within these limits (8 KB and 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
# A word in more than one text of HOT is hot (there are at most HOT times as many as words in a
# text on average); its rows are dealt out to SPLIT keys.
HOT, SPLIT = 64, 32

WORD = r"([\p{L}\p{N}_]+)"


class BitTable:
    """A bit for the hash of each value of a table's one column, as one array that every task gets."""

    def __init__(self, values: DataFrame):
        self.bits = LEAST_BITS
        wanted = min(MOST_BITS, BITS_EACH * values.count())
        while self.bits < wanted:
            self.bits *= 2
        place = self._place(F.col(values.columns[0])).alias("p")
        words = values.select(place).groupBy(F.shiftright("p", 6).cast("int").alias("slot")).agg(F.bit_or(self._bit(F.col("p"))).alias("b"))
        # All slots in order, those without a value as 0.
        slots = values.sparkSession.range(self.bits >> 6).select(F.col("id").cast("int").alias("slot"))
        every = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("b", F.lit(0)).alias("b"))))
        self.table = slots.join(words, "slot", "left").agg(every.alias("t")).select(F.col("t.b").alias("_bits"))

    def _place(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.bits))

    @staticmethod
    def _bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))

    def _hit(self, table: Column, value: Column) -> Column:
        place = self._place(value)
        return F.get(table, F.shiftright(place, 6).cast("int")).bitwiseAND(self._bit(place)) != 0

    def may_have(self, value: Column) -> Column:
        """Whether the bit of ``value`` is set (false for null)."""
        return value.isNotNull() & self._hit(self.table.scalar(), value)

    def rows_with_all(self, df: DataFrame, values: Column) -> DataFrame:
        """The rows of ``df`` for which the bits of all of an array are set; they stay where they are."""
        return df.join(F.broadcast(self.table), F.forall(values, lambda v: self._hit(F.col("_bits"), v)), "left_semi")


def text_words(text: Column) -> Column:
    """The distinct words of a text: runs of letters, digits and ``_``."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 1))


def names_by_rarest_word(words: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, word, n)``: each name under its rarest word, which ``n`` of the texts hold.

    ``words`` has a row ``word`` for each distinct word of each text.
    """
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    seen = BitTable(counts.select("word"))
    possible = seen.rows_with_all(names.select("name"), text_words(F.col("name"))).distinct()
    known = possible.select("name", F.explode(text_words(F.col("name"))).alias("word")).join(counts, "word", "left")
    least = known.groupBy("name").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("word", F.struct("n", "word")).alias("word")
    )
    return least.where("n > 0").select("name", "word", "n")


def names_in_texts(df: DataFrame, names: DataFrame, text_col: str) -> DataFrame:
    """``(key, names)``: for each text that may hold some, by its hash, the names, longer ones first.

    A name may stand in a text that has the name's rarest word.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), text_words(F.col(text_col)).alias("words"))
    # Filtered inside explode: of a bare array the optimizer would test the size first, and so cut the text twice.
    word = F.explode(F.filter("words", lambda w: w.isNotNull())).alias("word")
    index = written(names_by_rarest_word(texts.select(word), names), "names")
    total = df.count()
    hot = index.where(F.col("n") > max(1, total // HOT)).select("word").distinct()
    part = F.sequence(F.lit(0), F.lit(SPLIT - 1))
    dealt = index.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "word", "left").select(
        "name", "word", F.explode(F.when(F.col("_hot"), part).otherwise(F.array(F.lit(0)))).alias("part")
    )
    keys = BitTable(index.select("word").distinct())
    asked = texts.select(F.md5("text").alias("key"), word).where(keys.may_have(F.col("word")))
    asked = asked.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "word", "left").select(
        "key", "word", F.when(F.col("_hot"), F.pmod(F.xxhash64("key"), F.lit(SPLIT))).otherwise(0).cast("int").alias("part")
    )
    longest = F.sort_array(F.collect_set(F.struct((-F.length("name")).alias("n"), F.col("name").alias("name"))))
    found = asked.join(dealt, ["word", "part"]).groupBy("key").agg(longest.alias("found"))
    return found.select("key", F.transform("found", lambda x: x["name"]).alias("names"))


def with_names(df: DataFrame, names: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with the names that may stand in each row's text (null: none). Texts without any are not shuffled."""
    found = written(names_in_texts(df, names, text_col), "found").withColumnRenamed("names", out_col)
    keyed = df.withColumn("_key", F.md5(text_col))
    hit = BitTable(found.select("key")).may_have(F.col("_key"))
    rest = keyed.where(~hit).withColumn(out_col, F.lit(None).cast("array<string>"))
    hits = keyed.where(hit).join(found.withColumnRenamed("key", "_key"), "_key", "left")
    columns = [*df.columns, out_col]
    return rest.select(columns).unionByName(hits.select(columns))
