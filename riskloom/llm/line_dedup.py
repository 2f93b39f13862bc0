"""Near-duplicate lines: a segment-partition edit join in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.session import materialise, new_path

#: Most edits between linked lines.
EDITS = 2
#: A line of n characters may differ in n // CHARS_PER_EDIT edits at most; shorter lines link to equal ones only.
CHARS_PER_EDIT = 10
#: Letters counted in the signature of a line, 3 bits each.
LETTERS = "etnaiorshdluc"
#: Bits of a count in the signature.
COUNTER = 3
#: So many candidate lines are sent to all tasks; more are fetched by a shuffle.
BROADCAST_LINES = 1_000_000


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written compressed to the shared folder, and where."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(df: DataFrame, *paths: str) -> None:
    """Delete tables that a later, written one replaces."""
    spark = df.sparkSession
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, id): the lines that have a word; ``id`` is a digest of the whole line."""
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return each.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumn("id", line_id(F.col("line")))


def line_id(line: Column) -> Column:
    """A digest of the whole line."""
    return F.unhex(F.md5(line.cast("binary")))


def tag(line: Column) -> Column:
    """A hash of the line whose low bits count LETTERS, each modulo 8, and above them its characters modulo 8.

    Letters are taken out one after the other, so every count reads a shorter
    rest; the state keeps the length before, and counts trail by a step.  Tags
    only choose candidates: lines sharing one are told apart by their id.
    """
    size = lambda t: F.octet_length(t).cast("bigint")
    packed = lambda s: F.shiftleft(s["v"], 3).bitwiseOR((s["l"] - size(s["t"])).bitwiseAND(F.lit(7).cast("bigint")))
    # The first count packed is what the start adds to the size: the characters.
    start = F.struct(line.alias("t"), (size(line) + F.char_length(line)).alias("l"), F.lit(0).cast("bigint").alias("v"))

    def step(s: Column, letter: Column) -> Column:
        return F.struct(F.replace(s["t"], letter, F.lit("")).alias("t"), size(s["t"]).alias("l"), packed(s).alias("v"))

    counts = F.aggregate(F.array(*[F.lit(c) for c in LETTERS]), start, step, packed)
    return F.xxhash64(line).bitwiseAND(F.lit(-1 << COUNTER * (len(LETTERS) + 1))).bitwiseOR(counts)


def letters_agree(a: Column, b: Column, edits: int) -> Column:
    """Whether the counts in two tags leave ``edits`` (3 at most) possible; never false for a pair in reach.

    An edit adds one letter at most and takes one away at most, so neither the
    gains nor the losses, summed over the letters, exceed the edits.  If one
    line is longer by some characters, as many edits are pure insertions there
    and take nothing away.
    """
    if 2 * edits >= 1 << COUNTER:
        raise ValueError("the counters of a tag do not tell gains from losses at so many edits")

    def change(i: int) -> Column:
        at = lambda c: F.shiftright(c, COUNTER * i).bitwiseAND(F.lit(7).cast("bigint"))
        return (at(a) - at(b) + 4).bitwiseAND(F.lit(7).cast("bigint")) - 4

    changes = [change(i) for i in range(len(LETTERS))]
    gains = reduce(lambda x, y: x + y, [F.greatest(d, F.lit(0)) for d in changes])
    losses = reduce(lambda x, y: x + y, [F.greatest(-d, F.lit(0)) for d in changes])
    longer = change(len(LETTERS))
    return (gains <= edits - F.greatest(-longer, F.lit(0))) & (losses <= edits - F.greatest(longer, F.lit(0)))


def _length(n: Column, i: int | Column, edits: int) -> Column:
    """Length of segment i of a line of n characters: the last ones are the longer."""
    return F.floor((n + i) / (edits + 1)).cast("int")


def _start(n: Column, i: int, edits: int) -> Column:
    return reduce(lambda a, j: a + _length(n, j, edits), range(i), F.lit(1))


def _key(at: Column, size: Column, i: Column, length: Column) -> Column:
    """Hash of ``size`` characters of the line from ``at``, as segment i of a line of ``length`` characters.

    Where every character is one byte, bytes are cut at once instead of counting characters from the start of the line.
    """
    cut = lambda text: F.xxhash64(F.substring(text, at, size), i, length)
    line = F.col("line")
    return F.when(F.octet_length(line) == F.col("n"), cut(line.cast("binary"))).otherwise(cut(line))


def segments(edits: int) -> Column:
    """Keys of a line's own ``edits`` + 1 segments."""
    n = F.col("n")
    return F.array(*[_key(_start(n, i, edits), _length(n, i, edits), F.lit(i), n) for i in range(edits + 1)])


def probes(lines: DataFrame, edits: int) -> DataFrame:
    """(b, key): keys under which a line (tag, line, n) looks for lines shorter by up to ``edits``.

    For every length and segment only those substrings are tried whose shift
    leaves few enough edits to both sides of the segment.  Lines of one length
    that share a segment in place meet by their own segments and need no try.
    The tries are rows of a fixed list, so one short expression makes all keys.
    """
    tries = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            right = edits - i
            shifts = range(max(-i, shorter - right), min(i, shorter + right) + 1)
            tries += [(shorter, i, shift) for shift in shifts if shorter or shift]
    listed = F.array(*[F.struct(F.lit(m).alias("shorter"), F.lit(i).alias("i"), F.lit(d).alias("shift")) for m, i, d in tries])
    rows = lines.select("tag", "line", "n", F.explode(listed).alias("t")).select("tag", "line", "n", F.col("t.i").alias("i"), F.col("t.shift").alias("shift"), (F.col("n") - F.col("t.shorter")).alias("m"))
    before = [F.when(F.col("i") > j, _length(F.col("m"), j, edits)).otherwise(F.lit(0)) for j in range(edits)]
    at = reduce(lambda x, y: x + y, before, F.lit(1)) + F.col("shift")
    size = _length(F.col("m"), F.col("i"), edits)
    fits = (F.col("m") >= CHARS_PER_EDIT) & (at >= 1) & (at + size - 1 <= F.col("n"))
    return rows.where(fits).select(F.col("tag").alias("b"), _key(at, size, F.col("i"), F.col("m")).alias("key"))


def edit_distance(left: Column, right: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is ``edits`` at most, else NULL: a banded automaton in one integer.

    Register e holds one bit per diagonal: which prefixes of ``left`` the prefix of
    ``right`` read so far reaches with e edits at most.  One character moves all
    diagonals of all registers by shifts and masks.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    m, n = F.size(left), F.size(right)

    def matches(j: Column) -> Column:
        bits = [F.when(F.get(left, j + (d - edits)) == F.get(right, j), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    def step(state: Column, same: Column) -> Column:
        register = lambda e: F.shiftright(state, width * e).bitwiseAND(F.lit(ones))
        new = [register(0).bitwiseAND(same)]
        for e in range(1, edits + 1):
            old = register(e - 1)
            moved = register(e).bitwiseAND(same).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(moved.bitwiseAND(F.lit(ones)))
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(r, width * e) for e, r in enumerate(new)])

    start = sum(((1 << (e + 1)) - 1) << edits + width * e for e in range(edits + 1))
    if width * (edits + 1) > 30:
        raise ValueError("the registers of so many edits do not fit an integer")
    masks = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), matches)
    end = F.array(F.aggregate(masks, F.lit(start), step))
    diagonal = m - n + edits
    # The array binds the end state, which is worked out once and read per register.
    reached = F.transform(end, lambda x: F.coalesce(*[F.when(F.getbit(x, diagonal + width * e) == 1, F.lit(e)) for e in range(edits + 1)]))
    return F.when(F.abs(m - n) <= edits, reached[0])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings (up to 2 ** 21 - 1), found by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(21))])

    def step(at: Column, more: Column) -> Column:
        same = (at + more <= most) & (F.substring(a, at + 1, more) == F.substring(b, at + 1, more))
        return F.when(same, at + more).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def can_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings without a common prefix or suffix can be ``edits`` apart; never false when they are.

    The first and the last step from one to the other are edits.  With two edits
    everything between them matches, so the characters after the first do too.
    """
    if edits != 2:
        return F.lit(True)
    piece = lambda text, at: F.substring(text, F.lit(at), F.lit(12))
    follow = (piece(a, 2) == piece(b, 2)) | (piece(a, 2) == piece(b, 1)) | (piece(a, 1) == piece(b, 2))
    return (F.greatest(F.char_length(a), F.char_length(b)) <= 14) | follow


def candidates(distinct: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): tags of lines that share a segment and whose letters agree, and (tag, tag) where several lines have one tag."""
    long = distinct.where(F.col("n") >= CHARS_PER_EDIT)
    index = long.select(F.col("tag").alias("a"), F.explode(segments(edits)).alias("key"))
    probe = probes(long, edits)
    # The same plan on both sides, so that its exchange is made once.
    left, right = index.alias("l"), index.alias("r")
    placed = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.a") < F.col("r.a")) & letters_agree(F.col("l.a"), F.col("r.a"), edits))
    placed = placed.select(F.col("l.a").alias("a"), F.col("r.a").alias("b"))
    moved = index.join(probe, (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & letters_agree(F.col("a"), F.col("b"), edits))
    met = placed.unionByName(moved.select("a", "b"))
    shared = long.groupBy("tag").count().where("count > 1").select(F.col("tag").alias("a"), F.col("tag").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().unionByName(shared)


def line_links(distinct: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b, distance): ids of all pairs of different lines within reach of each other.

    ``distinct`` has one row per line: id, line, n (characters), tag.  Two lines
    of n and m characters are in reach at min(n, m) // CHARS_PER_EDIT edits or
    fewer, and never beyond ``edits``.  With one segment more than edits, at
    least one segment is untouched, so no pair is missed.  Lines with the same
    tag are compared whether or not they share a segment.
    """
    pairs, at = stored(candidates(distinct, edits), "candidates")
    tags, at_tags = stored(pairs.select(F.col("a").alias("tag")).unionByName(pairs.select(F.col("b").alias("tag"))).distinct(), "tags")
    few = tags.count() <= BROADCAST_LINES
    texts = distinct.join(F.broadcast(tags) if few else tags, "tag", "left_semi").select("tag", "id", "line", "n")
    texts, at_texts = stored(texts, "candidate-lines")
    both = pairs.join(texts.toDF("a", "id_a", "line_a", "n_a"), "a").join(texts.toDF("b", "id_b", "line_b", "n_b"), "b").where("id_a <> id_b AND (a <> b OR id_a < id_b)")
    # What is equal at both ends leaves the distance as it is.
    cut = both.select("id_a", "id_b", F.least("n_a", "n_b").alias("n"), "line_a", "line_b", common_prefix(F.col("line_a"), F.col("line_b")).alias("p"))
    rest = lambda c: F.substring(c, F.col("p") + 1, F.char_length(c))
    cut, at_heads = stored(cut.select("id_a", "id_b", "n", rest("line_a").alias("a"), rest("line_b").alias("b")), "heads")
    discard(cut, at, at_tags, at_texts)
    cut = cut.select("id_a", "id_b", "n", "a", "b", common_prefix(F.reverse("a"), F.reverse("b")).alias("q"))
    rest = lambda c: F.substring(c, F.lit(1), F.char_length(c) - F.col("q"))
    cut, at_middles = stored(cut.select("id_a", "id_b", "n", rest("a").alias("a"), rest("b").alias("b")), "middles")
    discard(cut, at_heads)
    # Written as arrays and with their distance, so that neither is worked out again for each use.
    near = cut.where(can_be_near(F.col("a"), F.col("b"), edits))
    near, at_near = stored(near.select("id_a", "id_b", "n", F.split("a", "").alias("a"), F.split("b", "").alias("b")), "near")
    discard(near, at_middles)
    found, _ = stored(near.select("id_a", "id_b", "n", edit_distance(F.col("a"), F.col("b"), edits).alias("distance")), "distances")
    discard(found, at_near)
    found = found.where((F.col("distance") > 0) & (F.col("distance") <= F.floor(F.col("n") / CHARS_PER_EDIT)))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "distance").distinct()


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, line, n, tag, copies, first): one row per different line; ``first`` is its first (doc_id, line_no)."""
    # Grouped by the line itself: digests of what is distinct are made afterwards and need no exchange.
    each = lines(docs).groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies"))
    rows = each.select(line_id(F.col("line")).alias("id"), "line", F.char_length("line").alias("n"), tag(F.col("line")).alias("tag"), "copies", "first")
    return stored(rows, "lines")[0]


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, n_copies, n_links) of every line that has a word.

    Lines chain into classes over links of ``edits`` or fewer; the class is
    named by its first line in the order of doc_id and line number.  ``n_copies``
    counts equal lines, ``n_links`` the different lines within reach.  NULL and
    empty texts have no lines; repeated rows repeat their lines; a NULL doc_id
    sorts first.
    """
    distinct = distinct_lines(docs)
    links = materialise(line_links(distinct, edits), "links")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "id").join(ends, "id")
    linked = materialise(distinct.select("id", "first", "copies").join(roots, "id"), "linked-lines")
    names = linked.groupBy("root").agg(F.min("first").alias("named"))
    classes = linked.join(names, "root").select("id", F.col("named").alias("class"), "copies", "n_links")
    repeated = distinct.where("copies > 1").select("id", F.col("first").alias("class"), "copies", F.lit(0).cast("bigint").alias("n_links"))
    told = classes.unionByName(repeated.join(classes.select("id"), "id", "left_anti"))
    told = materialise(told, "line-classes")
    # An id may hold a third of all lines; partitions of this join are split by adaptive execution.
    each = lines(docs).select("doc_id", "line_no", "id").join(told, "id", "left")
    return each.select(
        "doc_id", "line_no", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_doc_id"),
        F.coalesce("class.line_no", "line_no").alias("class_line_no"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_near_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with only those lines in each text that are the first of their class; rows and columns stay as they are.

    Rows are told apart by themselves, not by doc_id: rows that share an id, or
    have none, keep their own texts, and of equal lines in such rows one stays.
    The first line is that of the smallest doc_id (NULL sorts first), then of
    the row read first.  Lines without a word stay, NULL texts stay NULL, and a
    text whose lines are all repeats becomes empty.
    """
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # written, so a row keeps its number
    classes = line_classes(numbered.select(F.struct("doc_id", "__row").alias("doc_id"), "text"), edits)
    place = F.struct(F.col("doc_id.__row"), "line_no")
    repeats = classes.where(place != F.struct(F.col("class_doc_id.__row"), "class_line_no"))
    gone = repeats.groupBy(F.col("doc_id.__row").alias("__row")).agg(F.collect_list("line_no").alias("__gone"))  # lines of one text
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    own = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    return numbered.join(gone, "__row", "left").select(*own)
