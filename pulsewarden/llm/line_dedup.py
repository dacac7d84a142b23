"""Line dedup within an edit distance, by segment partition.

A line is cut into limit + 1 segments. If another line is within `limit` edits, one of the segments stands
unchanged in it, at a place that the edits before and after it bound. So segments go into an index keyed by
(length of the line, segment number, text), and every line probes it, for each length from its own down to
`limit` below, with the few substrings that may be such a segment. Keys are hashes; what meets is verified on the
lines themselves: common ends are cut off and the cores compared in a band of 2 * limit + 1
diagonals whose states are the bits of one long per number of edits.

Lines that meet under a key are gathered in blocks of bounded size, and blocks are compared with blocks, each two
of them a row of their own, so neither pairs nor unbounded groups ever become rows and a hot key's work is dealt
out. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared


def _specs(limit: int, probes: bool) -> list[tuple[int, int, int]]:
    """(less, segment number, move) of the segments of a line itself or of those that its neighbours may have.

    For a line shorter by `less`, segment no can have moved by `move` only if |move| <= no and
    |move - less| <= limit - no.
    """
    if not probes:
        return [(0, no, 0) for no in range(limit + 1)]
    moves = lambda less, no: range(max(-no, less - (limit - no)), min(no, less + (limit - no)) + 1)
    return [(less, no, move) for less in range(limit + 1) for no in range(limit + 1) for move in moves(less, no)]


def segment_keys(lines: DataFrame, limit: int, *, probes: bool) -> DataFrame:
    """(id, key): one row for each segment of each line, or for each place where a neighbour's segment may stand.

    The few specs are one literal array that is exploded first, so the key is one small expression a row. The
    first limit + 1 - size % (limit + 1) segments of a line have size / (limit + 1) characters, the others one more;
    places outside the line give no row.
    """
    parts = limit + 1
    specs = F.array(*[F.struct(F.lit(x).alias("less"), F.lit(y).alias("no"), F.lit(z).alias("move")) for x, y, z in _specs(limit, probes)])
    rows = lines.select("id", "line", F.length("line").alias("own"), F.explode(specs).alias("spec"))
    rows = rows.select("id", "line", "own", (F.col("own") - F.col("spec.less")).alias("size"), F.col("spec.no").alias("no"), F.col("spec.move").alias("move"))
    over = F.pmod("size", F.lit(parts))
    short = ((F.col("size") - over) / parts).cast("int")
    length = short + (F.col("no") >= parts - over).cast("int")
    start = short * F.col("no") + F.greatest(F.lit(0), F.col("no") + over - parts) + F.col("move")
    inside = (F.col("size") >= 0) & (start >= 0) & (start + length <= F.col("own"))
    return rows.where(inside).select("id", F.xxhash64("size", "no", F.col("line").substr(start + 1, length)).alias("key"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _common_start(a: Column, b: Column, most: Column) -> Column:
    """Length of the common start of a and b, `most` at most, by doubling steps downwards."""
    steps = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))
    def go(at: Column, k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), k)
        return F.when((at + size <= most) & (a.substr(at + 1, size) == b.substr(at + 1, size)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def within(a: Column, b: Column, limit: int) -> Column:
    """Whether strings a and b are at most `limit` edits apart (limit up to 30)."""
    width, mask = 2 * limit + 1, (1 << (2 * limit + 1)) - 1
    long = lambda x: F.lit(x).cast("bigint")

    def band(c: Column) -> Column:
        return _let(F.struct(F.split(c["a"], "").alias("a"), F.split(c["b"], "").alias("b"), F.length(c["a"]).alias("n"), F.length(c["b"]).alias("m")), compare)

    def compare(c: Column) -> Column:
        left, right, n, m = c["a"], c["b"], c["n"], c["m"]
        names = [f"r{d}" for d in range(limit + 1)]
        start = F.struct(*[long(sum(1 << (limit + k) for k in range(d + 1)) & mask).alias(x) for d, x in enumerate(names)])

        def step(state: Column, j: Column) -> Column:
            char = F.get(right, j - 1)
            same = long(0)
            for k in range(width):
                same = same.bitwiseOR(F.when(F.get(left, j - limit + k - 1) == char, long(1 << k)).otherwise(long(0)))

            def advance(same: Column) -> Column:
                new = [state["r0"].bitwiseAND(same)]
                for d in range(1, limit + 1):
                    old, less = state[f"r{d}"], state[f"r{d - 1}"]
                    moved = old.bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[d - 1], 1))
                    new.append(moved.bitwiseAND(long(mask)))
                return F.struct(*[x.alias(y) for x, y in zip(new, names)])

            return F.when(state[f"r{limit}"] == 0, state).otherwise(_let(same, advance))

        def reached(state: Column) -> Column:
            end = F.call_function("shiftleft", long(1), (n - m + limit).cast("int"))
            return state[f"r{limit}"].bitwiseAND(end) != 0

        return F.when((n == 0) | (m == 0), F.greatest(n, m) <= limit).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, step, reached))

    def without_end(c: Column) -> Column:
        most = F.least(F.length(c["a"]), F.length(c["b"]))
        def cut(s: Column) -> Column:
            return F.struct(c["a"].substr(F.lit(1), F.length(c["a"]) - s).alias("a"), c["b"].substr(F.lit(1), F.length(c["b"]) - s).alias("b"))

        return _let(_let(_let(F.struct(F.reverse(c["a"]).alias("a"), F.reverse(c["b"]).alias("b")), lambda r: _common_start(r["a"], r["b"], most)), cut), band)

    def without_start(s: Column) -> Column:
        return _let(F.struct(a.substr(s + 1, F.length(a)).alias("a"), b.substr(s + 1, F.length(b)).alias("b")), without_end)

    close = F.abs(F.length(a) - F.length(b)) <= limit
    return F.when(close, _let(_common_start(a, b, F.least(F.length(a), F.length(b))), without_start)).otherwise(F.lit(False))


def _left(text: Column, gone: Column, make) -> Column:
    """make(lines, place) of each line of a text whose place is not among `gone` (null: none), in time that grows with the lines alone."""
    lines = F.split(text, "\n")
    none = F.array().cast("array<int>")

    def of(c: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(c["lines"]) - 1), c["gone"])
        return F.transform(places, lambda p: make(c["lines"], p))

    return _let(F.struct(lines.alias("lines"), F.coalesce(gone, none).alias("gone")), of)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _lines(keyed: DataFrame, least: int, every: bool = False) -> DataFrame:
    """(doc, hash, pos, line) of the lines that take part: those of `least` characters and, with `every`, all that are not blank."""
    taken = F.length("line") >= least
    if every:
        taken = taken | F.col("line").rlike(r"\S")
    return keyed.select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(taken)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most `rows` (narrow) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeats(lines: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc, hash, again): of each document the places of lines that stand earlier, by id and place, as they are.

    Lines are known by two 64-bit hashes; only hashes and places are shuffled, combined before they are. A line
    that very many documents have is one row of the table that all its places are joined with: broadcast if small,
    else a sort-merge join whose hot partitions Spark splits.
    """
    places = lines.select("doc", "hash", "pos", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("twin"))
    place = F.struct("doc", "hash", "pos")
    often = places.groupBy("id", "twin").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    often = shared.cut(often, "repeated-lines")
    again = places.join(_small(often, broadcast_rows), ["id", "twin"]).where(place > F.col("first"))
    return shared.cut(again.groupBy("doc", "hash").agg(F.collect_set("pos").alias("again")), "repeats")


def near_lines(lines: DataFrame, *, limit: int = 2, least: int = 20, broadcast_rows: int = 500_000, block: int = 64) -> DataFrame:
    """(place, line, earlier): lines that have an earlier line within `limit` edits, with the earliest such place.

    lines are (doc, hash, pos, line), each text at one place (repeats of that place do no harm). Lines of `least` characters are
    judged; all that are given serve as earlier ones.
    """
    lines = lines.withColumn("id", F.xxhash64("line"))
    judged = lambda line: F.length(line) >= least
    indexed = segment_keys(lines, limit, probes=False)
    probing = segment_keys(lines.where(judged("line")), limit, probes=True)
    stored = indexed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = probing.join(stored, "key").where("low <> id OR high <> id").select("key", "id").distinct()
    met = shared.cut(met, "probes")
    hit = indexed.join(_small(met.select("key").distinct(), broadcast_rows), "key").select("key", "id").distinct()
    hit = shared.cut(hit, "segments")
    wanted = shared.cut(met.select("id").unionByName(hit.select("id")).distinct(), "lines-wanted")
    texts = lines.join(_small(wanted, broadcast_rows), "id").groupBy("id", "line").agg(F.min(F.struct("doc", "hash", "pos")).alias("place"))
    texts = shared.cut(texts, "lines")

    def blocks(side: DataFrame, name: str, number: str, others: str, other: str) -> DataFrame:
        """Lines of a key in blocks, each block once for every block of the other side."""
        placed = side.join(texts, "id").join(counts, "key").withColumn(number, F.pmod(F.xxhash64("line", F.lit(name)), F.col(f"n_{name}")))
        placed = placed.groupBy("key", number).agg(F.collect_list(F.struct("line", "place")).alias(name), F.first(f"n_{others}").alias("n"))
        return placed.select("key", number, name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias(other))

    sizes = lambda side, name: side.groupBy("key").agg(F.ceil(F.count("*") / block).alias(f"n_{name}"))
    counts = shared.cut(sizes(met, "probes").join(sizes(hit, "stored"), "key"), "blocks")
    pairs = blocks(met, "probes", "p", "stored", "q").join(blocks(hit, "stored", "q", "probes", "p"), ["key", "p", "q"])
    match = lambda p, m: (p["line"] != m["line"]) & within(p["line"], m["line"], limit)
    first = lambda found: F.array_min(F.transform(found, lambda x: x["place"]))
    of_probes = F.transform("probes", lambda p: F.struct(p["line"].alias("line"), p["place"].alias("place"), first(F.filter("stored", lambda m: match(p, m))).alias("earlier")))
    longer = lambda m: F.filter("probes", lambda p: (F.length(p["line"]) > F.length(m["line"])) & (p["place"] < m["place"]) & match(p, m))
    of_stored = F.transform(F.filter("stored", lambda m: judged(m["line"])), lambda m: F.struct(m["line"].alias("line"), m["place"].alias("place"), first(longer(m)).alias("earlier")))
    compared = shared.cut(pairs.select(F.filter(F.concat(of_probes, of_stored), lambda x: x["earlier"] < x["place"]).alias("found")), "compared")
    found = compared.select(F.explode("found").alias("x"))
    return found.groupBy(F.col("x.place").alias("place"), F.col("x.line").alias("line")).agg(F.min("x.earlier").alias("earlier"))


def dedup(docs: DataFrame, *, limit: int = 2, least: int = 20, every: bool = False, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """Per row: doc_id, n_lines, n_repeated, n_near, kept_sha256, kept text.

    Lines end at line feeds. A line of at least `least` characters goes if the same line stands earlier (by
    id, then place) or if some earlier line of `least` characters is within `limit` edits of it; shorter lines
    always stay. With `every`, any line that is not blank goes if the same line stands earlier, and earlier lines
    of all lengths count for lines of `least` characters; only near matches of shorter lines stay. A line that goes still counts as earlier for others. Null texts are one empty line; rows that repeat an id and
    text count as one place, and so all keep the same lines; extra columns are ignored.

    Repeats are found first, by hashes alone, and cut from the documents, so the search for near lines sees every
    line once, at its first place, and a very common line is no hot key there.
    """
    keyed = _keyed(docs, id_col, text_col)
    again = _small(repeats(_lines(keyed, least, every), broadcast_rows), broadcast_rows)
    shortest = max(1, least - limit) if every else least
    left = keyed.join(again, ["doc", "hash"], "left")
    once = left.select("doc", "hash", F.explode(_left(F.col("text"), F.col("again"), lambda lines, p: F.struct(p.alias("pos"), F.get(lines, p).alias("line")))).alias("at"))
    once = once.select("doc", "hash", "at.*").where(F.length("line") >= shortest)
    near = near_lines(once, limit=limit, least=least, broadcast_rows=broadcast_rows).select("place.*")
    near = shared.cut(near.groupBy("doc", "hash").agg(F.collect_set("pos").alias("near")), "near")
    joined = left.join(_small(near, broadcast_rows), ["doc", "hash"], "left")
    lines = F.split("text", "\n")
    none = F.array().cast("array<int>")
    gone = F.concat(F.coalesce("again", none), F.coalesce("near", none))
    kept = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(_left(F.col("text"), gone, F.get), "\n"))
    count = lambda name: F.size(F.coalesce(name, none)).cast("long")
    out = joined.select(F.col("id").alias(id_col), F.size(lines).cast("long").alias("n_lines"), count("again").alias("n_repeated"), count("near").alias("n_near"), kept.alias("kept"))
    return out.select(id_col, "n_lines", "n_repeated", "n_near", F.sha2("kept", 256).alias("kept_sha256"), "kept")
