"""Quality rules with cross-document line frequency (native DataFrame functions only).

Each line is normalised (A-Z lower-cased, white space squeezed and trimmed) and hashed; the number of
distinct documents of a host which hold it is counted. A line held by more documents than the host's limit
is removed, and a document of which too little is left is rejected, as one that fails the base rules is.

Defined results: null or empty text has no words and fails the base rules. A null source is a host of its own.
Rows equal in doc_id, source and text count as one document and get equal results; rows that share doc_id only are different
documents. An empty table gives an empty result. Columns beyond doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """How many words lie in windows of `width` words found at least twice in the text."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

        def total(at: Column) -> Column:
            step = lambda x, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(at, j - 1)))
            return F.aggregate(F.transform(at, step), F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(ordered, lambda s: _let(F.sort_array(repeats(s)), total))
        )

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(_let(words, lambda w: _let(hashed(w), covered))).cast("long")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normalise(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _CAPITALS, _SMALL), _SPACES, " "))


def base_rules(docs: DataFrame, least_words: int = 20, most_repeat_percent: int = 30) -> DataFrame:
    """doc_id, source, text with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), has_word)
    found = docs.select("doc_id", "source", "text").withColumn(
        "_made",
        _let(
            split_words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_window_words(w).alias("n_repeat_words"),
            ),
        ),
    )
    failed = (F.col("_made.n_words") < least_words) | (
        100 * F.col("_made.n_repeat_words") > most_repeat_percent * F.col("_made.n_words")
    )
    return found.select("doc_id", "source", "text", "_made.*", failed.alias("base_failed"))


def _keys() -> dict:
    """Columns k1, k2 which tell documents apart: doc_id, and a hash of text and source."""
    source = F.coalesce(F.concat(F.lit("h"), F.col("source")), F.lit(""))
    return {
        "k1": F.coalesce(F.col("doc_id").cast("string"), F.lit("~")),
        "k2": F.xxhash64(F.coalesce(F.col("text"), F.lit("")), source),
        "host": F.xxhash64(source),
    }


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: k1, k2 (the document), host, pos, line (hash of the normalised line), n (its words)."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), has_word)
    one = lambda x: F.struct(F.xxhash64(normalise(x)).alias("line"), F.size(split_words(x)).alias("n"))
    keys = [c.alias(k) for k, c in _keys().items()]
    return docs.select(*keys, F.posexplode(F.transform(lines, one)).alias("pos", "x")).select("k1", "k2", "host", "pos", "x.line", "x.n")


def frequent_lines(lines: DataFrame, hosts: DataFrame, least_docs: int, least_percent: float) -> DataFrame:
    """host, line of the lines which more distinct documents hold than least_docs and least_percent of their host's documents."""
    return (
        lines.groupBy("host", "line")
        .agg(F.count_distinct("k1", "k2").alias("n_docs"))
        .where(F.col("n_docs") > least_docs)
        .join(hosts, "host")
        .where(F.col("n_docs") * 100.0 > F.col("host_docs") * F.lit(float(least_percent)))
        .select("host", "line")
    )


def line_frequency_filter(
    docs: DataFrame,
    least_docs: int = 20,
    least_percent: float = 2.0,
    least_left_percent: int = 50,
    salts: int = 16,
    least_words: int = 20,
    most_repeat_percent: int = 30,
) -> DataFrame:
    """Base rules, words of removed lines and the verdict of each document.

    Returns doc_id, source, text, the base columns, n_removed_words and kept. Frequent lines meet their documents
    in a join salted by the document, so that a line which a third of all documents hold is dealt to many tasks.
    """
    lines = document_lines(docs)
    hosts = docs.select(*(c.alias(k) for k, c in _keys().items())).groupBy("host").agg(F.count_distinct("k1", "k2").alias("host_docs"))
    frequent = frequent_lines(lines, hosts, least_docs, least_percent).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    removed = (
        lines.withColumn("salt", F.pmod("k2", F.lit(salts)).cast("int"))
        .join(frequent, ["host", "line", "salt"])
        .groupBy("k1", "k2", "pos")
        .agg(F.first("n").alias("n"))
        .groupBy("k1", "k2")
        .agg(F.sum("n").alias("hit"))
    )
    base = base_rules(docs, least_words, most_repeat_percent)
    base = base.withColumns({k: c for k, c in _keys().items() if k != "host"})
    gone = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - gone) >= least_left_percent * F.col("n_words"))
    return base.join(removed, ["k1", "k2"], "left").withColumns({"n_removed_words": gone, "kept": kept}).drop("k1", "k2", "hit")
