"""An inverted index of file lines: where a stretch of lines, or a piece of a line, occurs.

Lines are told apart by two 64-bit hashes of their text, white space normalised. A
stretch of m lines is covered by two windows of 2^k lines (2^k <= m < 2^(k+1)), and
the hash of a window is made of those of its halves. So a file lists its windows of
the few lengths that its hunks need, and a join on the hashes gives all places of a
stretch: no line of the file is looked at for a hunk that does not match there. For
pieces of lines, a file lists the lines of the three-character strings that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import is_blank, is_even, let, normalize_line, once, sha1_content, split_lines, strip
from folioflow.operators.selection import KEY
from folioflow.operators.skew import lookup_join, only_named, skew_join
from folioflow.session import kept

# Characters of a listed string, and how many of a piece's strings are tried to find a rare one.
GRAM, TRIED = 3, 4
# Up to so many strings are sought in the lines of a file one by one.
FEW_GRAMS = 32


def line_key(line: Column) -> Column:
    """Struct (a, b, plain): two hashes of the normalised line, and whether only its ends were changed for it."""

    def key(norm: Column, plain: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(1), norm).alias("a"), F.xxhash64(F.lit(2), norm).alias("b"), plain.alias("plain"))

    def changed(bare: Column) -> Column:
        return let(normalize_line(bare), lambda norm: key(norm, bare == norm))

    return F.when(is_even(line), key(line, F.lit(True))).otherwise(let(strip(line), changed))


def window_level(length: Column) -> Column:
    """The greatest k with 2^k <= length; null below 1."""
    return F.when(length > 0, F.length(F.bin(length.cast("long"))) - 1)


def window_width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), level)


def window_keys(keys: Column, level: Column) -> Column:
    """Keys of all windows of 2^level lines, by their first line, from the keys of the lines."""

    def doubled(acc: Column, step: Column) -> Column:
        half = window_width(step - 1)

        def joined(i: Column) -> Column:
            one, two = F.get(acc, i), F.get(acc, i + half)
            return F.struct(
                F.xxhash64(one["a"], two["a"]).alias("a"), F.xxhash64(one["b"], two["b"]).alias("b"),
                (one["plain"] & two["plain"]).alias("plain"),
            )

        last = F.size(acc) - half - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), joined)).otherwise(F.slice(acc, 1, 0))

    return F.when(level < 1, keys).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(level, F.lit(1))), keys, doubled))


def identified(hunks: DataFrame, needle: Column) -> DataFrame:
    """Hunks with `_needle` and `_id`, 128 bits of a hash of what is asked: the file, the lines and how many of them lead.

    Hunks that ask the same of a file share their `_id`.
    """
    rows = hunks.withColumn("_needle", once(needle))
    absent = [F.col(c).isNull() for c in (*KEY, "_needle")]
    lines = F.transform("_needle", lambda line: F.coalesce(line, F.lit("\n")))
    asked = [*KEY, *absent, F.size("context_before"), F.size("_needle"), lines, F.transform("_needle", lambda line: line.isNull())]
    return rows.withColumn("_id", once(F.struct(F.xxhash64(F.lit(1), *asked).alias("a"), F.xxhash64(F.lit(2), *asked).alias("b"))))


def described(hunks: DataFrame, needle: Column, long_from: int | None = None) -> DataFrame:
    """What hunks ask of the index, stored: a row per question `_id` with its number of hunks `_rows`.

    `_m` lines are expected; `_level`, `_first` and `_last` name their two windows;
    `_tell` is the first line after the leading context that is not blank, `_plain`
    whether only its ends change when it is normalised. The lines, `_needle`, are
    there for questions of `long_from` lines or more; no other text is shuffled.
    """
    rows = identified(hunks, needle).withColumn("_keys", once(F.transform("_needle", line_key)))
    m, before, lines = F.size("_needle"), F.size("context_before"), F.col("_needle")
    tell = F.get(F.filter(F.sequence(before, F.greatest(m - 1, before)), lambda i: ~is_blank(F.get(lines, i))), F.lit(0))
    rows = rows.withColumns({"_m": m, "_level": window_level(m), "_tell": once(F.when(m > before, tell))})
    rows = rows.withColumn("_windows", once(window_keys(F.col("_keys"), F.col("_level"))))
    long_ = F.lit(False) if long_from is None else F.col("_m") >= long_from
    rows = rows.select(
        "_id", *KEY, "_m", "_level", "_tell", F.when(long_, lines).alias("_needle"),
        F.get("_windows", F.lit(0)).alias("_first"),
        F.get("_windows", F.size("_windows") - 1).alias("_last"),
        F.get("_keys", F.col("_tell"))["plain"].alias("_plain"),
    )
    # Equal questions meet before the shuffle.
    return kept(rows.groupBy(*rows.columns).agg(F.count("*").alias("_rows")))


def with_probe(asked: DataFrame, hunks: DataFrame, needle: Column) -> DataFrame:
    """Questions with `_probe`, the text of their telling line without space at its ends, read again from the hunks."""
    told = asked.select("_id", "_tell").distinct()
    rows = identified(hunks, needle).select("_id", "_needle", "response_id", "hunk_pos")
    rows = lookup_join(rows, told, ["_id"], "inner", ["response_id", "hunk_pos"])
    return asked.join(rows.select("_id", strip(F.get("_needle", F.col("_tell"))).alias("_probe")).distinct(), "_id")


def file_lines(files: DataFrame) -> DataFrame:
    """The files with their `_lines`; a null content has none."""
    return files.withColumn("_lines", once(F.coalesce(split_lines(F.col("content")), F.array().cast("array<string>"))))


def file_index(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Per file that is asked for, stored: base_sha1, n_lines, the keys of its lines, and `_levels`, the windows asked for.

    The keys are made before the shuffle, so that no content is moved. The lines
    themselves are read again from `files` for the few hunks that need them.
    """
    levels = kept(asked.groupBy(*KEY).agg(F.collect_set("_level").alias("_levels")))
    target = file_lines(only_named(files.select(*KEY, "content"), levels, KEY)).select(
        *KEY, once(sha1_content(F.col("content"))).alias("base_sha1"), F.size("_lines").alias("n_lines"),
        once(F.transform("_lines", line_key)).alias("_keys"),
    )
    return kept(target.join(levels, KEY).select(*KEY, "base_sha1", "n_lines", "_levels", "_keys"))


def places(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(_id, start, sure), stored: every place where all lines agree up to white space.

    `sure` says that the telling line, if there is one, agrees in its inner white
    space, too; where it is false that has to be looked up.
    """
    # A window's file and length go into its key, so that rows are joined by two numbers.
    named = lambda a, b: [F.xxhash64(*KEY, "_level", a).alias("a"), F.xxhash64("_level", *reversed(KEY), b).alias("b")]
    levels = index.select(*KEY, "_keys", F.explode("_levels").alias("_level"))
    windows = levels.select(*KEY, "_level", F.posexplode(window_keys(F.col("_keys"), F.col("_level"))).alias("_at", "_w"))
    windows = windows.select(*named(F.col("_w.a"), F.col("_w.b")), "_at", F.col("_w.plain").alias("_even"))
    rest = F.col("_m") - window_width(F.col("_level"))
    probe = lambda offset, key: F.struct(offset.alias("off"), F.col(f"{key}.a").alias("a"), F.col(f"{key}.b").alias("b"))
    both = F.when(rest > 0, F.array(probe(F.lit(0), "_first"), probe(rest, "_last"))).otherwise(F.array(probe(F.lit(0), "_first")))
    # A file without a full name is no file's; hashes pass over nulls.
    known = (F.col("_m") > 0) & F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()
    probes = asked.filter(known).select(
        "_id", *KEY, "_level", F.when(rest > 0, 2).otherwise(1).alias("_need"), "_plain", F.explode(both).alias("_p")
    ).select("_id", *named(F.col("_p.a"), F.col("_p.b")), "_p.off", "_need", "_plain")
    met = probes.join(windows, ["a", "b"])
    return kept(
        met.groupBy("_id", (F.col("_at") - F.col("off")).alias("start"), "_need", "_plain")
        .agg(F.count("*").alias("_n"), F.bool_and("_even").alias("_even"))
        .filter("_n = _need")
        .select("_id", "start", (F.col("_plain").isNull() | (F.col("_plain") & F.col("_even"))).alias("sure"))
    )


def numbered_lines(files: DataFrame, named: DataFrame) -> DataFrame:
    """(key, line, text) of the files that are named."""
    some = lookup_join(files.select(*KEY, "content"), named.select(*KEY).distinct(), KEY, "left_semi", KEY)
    return some.select(*KEY, F.posexplode(split_lines(F.col("content"))).alias("line", "text"))


def _grams(text: Column, length: Column) -> Column:
    last = F.length(text) - length + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, length))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _postings(tried: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, line, _gram), stored: the lines that hold the strings of `tried`.

    Where a file is asked for few strings, each is sought in its lines; where it is
    asked for many, its lines list the strings that they hold.
    """
    asked = kept(tried.groupBy(*KEY).agg(F.collect_set("_gram").alias("_all"), F.collect_set("_size").alias("_sizes")))
    few, many = asked.filter(F.size("_all") <= FEW_GRAMS), asked.filter(F.size("_all") > FEW_GRAMS)
    sought = lookup_join(lines, few, KEY, "inner", [*KEY, "line"])
    found = sought.select(*KEY, "line", F.explode(F.filter("_all", lambda gram: F.col("text").contains(gram))).alias("_gram"))
    if not many.isEmpty():
        listed = lookup_join(lines, many, KEY, "inner", [*KEY, "line"])
        each = listed.select(*KEY, "line", F.explode(F.flatten(F.transform("_sizes", lambda size: _grams(F.col("text"), size)))).alias("_gram"))
        wanted = many.select(*KEY, F.explode("_all").alias("_gram"))
        found = found.unionByName(lookup_join(each, wanted, [*KEY, "_gram"], "left_semi", ["line"]))
    return kept(found)


def piece_places(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """(_id, line): the lines that hold a piece of text (_id, key, _probe) of at least one character.

    Of a few strings of a piece the one that the fewest lines of the file hold is
    looked up; only the lines listed for it are compared with the piece.
    """
    size = F.least(F.length("_probe"), F.lit(GRAM))
    last = F.length("_probe") - size
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(TRIED - 1)), lambda i: (last * i / (TRIED - 1)).cast("int") + 1))
    tried = pieces.withColumn("_size", size).select(
        "_id", *KEY, "_size", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("_probe"), i, F.col("_size"))))).alias("_gram")
    )
    tried = kept(tried)
    lines = numbered_lines(files, pieces)
    postings = _postings(tried, lines)
    counts = postings.groupBy(*KEY, "_gram").agg(F.count("*").alias("_n"))
    rarest = tried.join(counts, [*KEY, "_gram"], "left").groupBy("_id").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")
    ).filter("_r.n > 0").select("_id", F.col("_r._gram").alias("_gram"))
    asked = pieces.select("_id", *KEY, "_probe").join(rarest, "_id")
    met = asked.join(postings, [*KEY, "_gram"]).select("_id", *KEY, "_probe", "line")
    texts = met.select(*KEY, "line").distinct().join(lines, [*KEY, "line"])
    return met.join(texts, [*KEY, "line"]).filter(F.col("text").contains(F.col("_probe"))).select("_id", "line")


def with_file(hunks: DataFrame, index: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Hunks with base_sha1 and n_lines of their file, null where there is none, and `file_exists`."""
    known = index.select(*KEY, "base_sha1", "n_lines")
    joined = skew_join(hunks, known, KEY, "left", ["_id"], counts=counts)
    return joined.withColumn("file_exists", F.col("base_sha1").isNotNull())
