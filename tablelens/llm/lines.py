"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if it, or a line within `edits` edits of it, stands earlier in the corpus. Lines of at least
`least` characters are compared: each is cut into edits + 1 segments, of which two lines within that
distance have one in common, and each looks up, for every length it may be compared with, those of its
substrings that can meet a segment of that length. Candidates whose letters allow it are verified by edit
distance, with a band of 2 * edits + 1 cells kept in the bits of a number and moved along the diagonal.

A segment with one or two owners gives its candidates in the same join. Lines that meet at a segment of more
owners make no pairs there: they are cut into 4, 8, 16, ... parts, and meet at all but the parts that hold an
edit, until few owners are left or the parts are single characters. What is equal but for two characters is
within two edits, so the earliest owner speaks for all.

What moves are hashes, places and, once, the texts: places of lines, segments and candidates are joined
back to the texts by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.llm.common import let, whole_text
from tablelens.session import cut_lineage

#: Letters counted to tell lines apart early.
LETTERS = "etaonirshd"
#: A document: its doc_id, null as the least number there is, and the hash of its text.
KEY = ["doc", "digest"]
NAMELESS = -(1 << 63)
#: Owners of a segment up to which all are compared: the least and the greatest id are all of them.
FEW = 2
#: Columns added by `dedup_lines`; columns of these names are replaced.
RESULTS = ("kept", "n_lines", "n_copies", "n_near")


def _keys(lines: DataFrame, ways: list[tuple[int, int, int]], edits: int, owner: str | None = None) -> DataFrame:
    """(id, line, n) -> (id, key): for each way (segment i, less, shift) the piece of the line at which segment i of a line
    `less` characters shorter would stand, moved by `shift`. Pieces reaching beyond the line give nothing.

    Segments are cut as evenly as can be, the last ones take what is left over. Under the name `owner`, if given, goes
    whether the piece is a segment of the line itself.
    """
    fields = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in ways))
    parts, i = edits + 1, F.col("i")
    spread = lines.select("id", "line", "n", F.explode(fields).alias("x")).select("id", "line", "n", "x.*")
    cut = spread.withColumn("of", F.col("n") - F.col("less"))
    cut = cut.withColumns({"short": F.floor(F.col("of") / parts).cast("int"), "even": parts - F.col("of") % parts})
    cut = cut.withColumn("start", F.col("short") * i + F.greatest(F.lit(0), i - F.col("even")) + F.col("shift") + 1)
    cut = cut.withColumn("size", F.col("short") + (i >= F.col("even")).cast("int"))
    inside = cut.filter("start >= 1 and start + size - 1 <= n")
    key = F.xxhash64("i", "of", F.substr("line", F.col("start"), F.col("size"))).alias("key")
    return inside.select("id", key, *([((F.col("less") == 0) & (F.col("shift") == 0)).alias(owner)] if owner else []))


def segments(lines: DataFrame, edits: int) -> DataFrame:
    """(id, key): number, the line's length, and the segment, for each of the edits + 1 segments."""
    return _keys(lines, [(i, 0, 0) for i in range(edits + 1)], edits)


def probes(lines: DataFrame, edits: int, owner: str | None = None) -> DataFrame:
    """(id, key): keys of the substrings that can meet a segment of a line as long or up to `edits` shorter; its own are among them."""
    ways = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            ways += [(i, less, shift) for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return _keys(lines, ways, edits, owner)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two lines in code points; any number above `edits` if it is above.

    Lengths must differ by `edits` at most and be over `edits`. Bit k of the band stands for the cell k - edits below the
    diagonal. Until the band reaches the last row its lowest cell is followed, after that the last row.
    """
    width = 2 * edits + 1
    mask, low = (1 << width) - 1, 1 << edits

    def no(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(mask))

    def step(state: Column, i: Column, a: Column, b: Column) -> Column:
        equal = F.lit(0)
        for k in range(width):
            met = F.get(a, i + (k - edits)) == F.get(b, i)
            equal = equal + F.when(met, 1 << k).otherwise(0)

        def moved(x: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            carried = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask)).bitwiseXOR(vp)
            return let(carried.bitwiseOR(x).bitwiseOR(vn), lambda d0: after(d0, vp, vn))

        def after(d0: Column, vp: Column, vn: Column) -> Column:
            hp, hn, shifted = vn.bitwiseOR(no(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            past = i - (F.size(a) - edits)  # rows that the band has moved past the last one
            bit = F.get(F.array(*(F.lit(1 << k) for k in range(width))), F.lit(width - 2) - past)
            down = F.when(d0.bitwiseAND(F.lit(1 << width - 1)) == 0, 1).otherwise(0)
            across = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(no(shifted.bitwiseOR(hp))).alias("vp"),
                shifted.bitwiseAND(hp).alias("vn"),
                (state["distance"] + F.when(past < 0, down).otherwise(across)).alias("distance"),
            )

        return let(equal, moved)

    start = F.struct(F.lit(mask & -low).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("distance"))

    def run(a: Column, b: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(b) - 1)
        return F.aggregate(places, start, lambda s, i: step(s, i, a, b), lambda s: s["distance"])

    return let(F.split(a, ""), lambda x: let(F.split(b, ""), lambda y: run(x, y)))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _apart(a: Column, b: Column) -> Column:
    """By how much the counts of LETTERS in two lines differ; an edit changes that by two at most."""

    def count(line: Column, letter: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))

    gaps = [F.abs(count(a, c) - count(b, c)) for c in LETTERS]
    return sum(gaps[1:], gaps[0])


def near_links(lines: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """(id, line, n) of distinct lines of n characters -> candidates, crowded.

    candidates: distinct pairs of ids (a, b), a < b, that meet at a segment with one or two owners; crowded:
    ids of the lines that meet at a segment of more. No line gives more than two rows for each of its probes.
    """
    # A segment is the probe for lines as long at its own place, so one shuffle brings owners and those that ask to a key.
    # `owner` stays in what is written, as both sides read the same shuffle only if they read the same columns.
    asked = probes(lines, edits, "owner").repartition("key")
    owner = F.when(F.col("owner"), F.col("id"))
    owners = asked.groupBy("key").agg(F.count(owner).alias("owners"), F.min(owner).alias("low"), F.max(owner).alias("high")).filter("owners > 0")
    alone = (F.col("low") == F.col("id")) & (F.col("high") == F.col("id"))
    met = cut_lineage(asked.join(owners, "key").filter(~alone).select("id", "owner", "owners", "low", "high"))
    few = met.filter(f"owners <= {FEW}").select("id", F.explode(F.array("low", "high")).alias("other")).filter("id != other")
    pairs = few.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return pairs, met.filter(f"owners > {FEW}").select("id").distinct()


def _apart_by(edits: int) -> list[tuple[int, int]]:
    """Shifts behind p and behind q that two parts with one edit each make; what lies in one part needs no second."""
    return [(s, s + e) for s in (-1, 0, 1) for e in (-1, 0, 1)] if edits > 1 else []


def _damage(edits: int) -> Column:
    """Where and how lines may differ, in four parts: the parts (p, q) that hold edits, shifts behind p and behind q."""
    one = [(p, p, 0, t) for p in range(4) for t in range(-edits, edits + 1)]
    two = [(p, q, *shifts) for p in range(4) for q in range(p + 1, 4) for shifts in _apart_by(edits)]
    return F.array(*(_state(*map(F.lit, x)) for x in one + two))


def _state(p: Column, q: Column, s: Column, t: Column) -> Column:
    named = {"p": p, "q": q, "s": s, "t": t}
    return F.struct(*(c.cast("long" if x in "pq" else "int").alias(x) for x, c in named.items()))


def _children(x: Column, edits: int) -> Column:
    """The same with each part halved."""
    p, q, s, t = (x[c] for c in "pqst")
    ways = (0, 1)
    apart = F.array(*(_state(2 * p + i, 2 * q + j, s, t) for i in ways for j in ways))
    both = [(i, i, F.lit(0), t) for i in ways] + [(0, 1, F.lit(a), F.lit(b)) for a, b in _apart_by(edits)]
    same = F.filter(F.array(*(_state(2 * p + i, 2 * q + j, a, b) for i, j, a, b in both)), lambda y: y["t"] == t)
    return F.when(p == q, same).otherwise(apart)


def crowded_links(lines: DataFrame, edits: int) -> DataFrame:
    """(at, line, n) of distinct lines -> candidate pairs (at_a, at_b), at_a < at_b, for one or two edits.

    Each line that has an earlier one within `edits` edits gets a candidate that is. An owner's parts are cut by
    its own length, those of the line that asks by the owner's. Only owners that stand earlier are asked. A line
    makes at most two pairs at what it shares with few owners; of owners in one place that differ in single
    characters there are no more than pairs of characters. For more than two edits all that share a segment meet.
    """
    if edits > 2:
        named = lines.select(F.col("at").alias("id"), "line", "n")
        owned, asked = segments(named, edits).withColumnRenamed("id", "a"), probes(named, edits).withColumnRenamed("id", "b")
        met = asked.join(owned, "key").filter("a != b")
        return met.select(F.least("a", "b").alias("at_a"), F.greatest("a", "b").alias("at_b")).distinct()
    states, parts, found = lines.select("at", F.explode(_damage(edits)).alias("x")), 4, []
    while True:
        held = lines.join(states, "at").withColumn("own", F.col("n") - F.col("x.t"))
        cut = {c: F.floor(F.col("own") * e / parts).cast("int") for c, e in _ends().items()}
        held = held.select("*", *(c.alias(name) for name, c in cut.items()))
        p, q, s, t = (F.col(f"x.{c}") for c in "pqst")
        first = F.when(p == q, t).otherwise(s)
        fits = (F.col("own") > 0) & (F.col("p1") + first >= F.col("p0")) & (F.col("q1") + t >= F.col("q0") + F.when(p == q, 0).otherwise(s))
        rest = (
            F.substr("line", F.lit(1), F.col("p0")),
            F.when(p < q, F.substr(F.col("line"), F.col("p1") + s + 1, F.col("q0") - F.col("p1"))).otherwise(""),
            F.substr(F.col("line"), F.col("q1") + t + 1, F.greatest(F.col("own") - F.col("q1"), F.lit(0))),
        )
        in_p = F.substr(F.col("line"), F.col("p0") + 1, F.col("p1") + first - F.col("p0"))
        in_q = F.substr(F.col("line"), F.col("q0") + s + 1, F.col("q1") + t - F.col("q0") - s)
        inside = F.xxhash64(in_p).alias("u"), F.xxhash64(in_q).alias("v")
        keyed = held.filter(fits).select("at", "x", "own", F.xxhash64(F.lit(parts), "own", p, q, *rest).alias("key"), *inside)
        keyed = cut_lineage(keyed.withColumn("owner", (F.col("x.s") == 0) & (F.col("x.t") == 0)))
        met = cut_lineage(_met(keyed))
        few, many = met.filter(f"owners <= {FEW} and low < at"), met.filter(f"owners > {FEW}")
        pairs = few.select(F.explode(F.array("low", "high")).alias("at_a"), F.col("at").alias("at_b")).filter("at_a < at_b")
        single = many.filter(F.col("own") <= parts)
        stars = single.filter("owner and low < at").select(F.col("low").alias("at_a"), F.col("at").alias("at_b"))
        named = single.filter("owner").select("key", F.col("at").alias("at_a"))
        moved = single.filter("not owner").select("key", F.col("at").alias("at_b")).join(named, "key").filter("at_a < at_b")
        found.append(pairs.union(stars).union(moved.select("at_a", "at_b")))
        more = many.filter(F.col("own") > parts)
        if more.isEmpty():
            break
        states = more.select("at", F.explode(_children(F.col("x"), edits)).alias("x")).distinct()
        parts *= 2
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links.distinct()


def _met(keyed: DataFrame) -> DataFrame:
    """Rows with the owners, low and high of their key, of those that may have an earlier owner there or that others may ask for.

    Of two parts each holds one edit: what has the same in either as all owners asks for nothing, as what differs in one
    part only meets at that part alone. `u` and `v` are hashes of what stands in the parts.
    """
    own = {c: F.when(F.col("owner"), F.col(c)) for c in ("at", "u", "v")}
    told = keyed.groupBy("key").agg(
        F.count_if("owner").alias("owners"), F.count_if(~F.col("owner")).alias("others"),
        F.min(own["at"]).alias("low"), F.max(own["at"]).alias("high"),
        *(f(own[c]).alias(f"{c}_{name}") for c in "uv" for name, f in (("low", F.min), ("high", F.max))),
    )
    u, v = (F.col(f"{c}_low") != F.col(f"{c}_high") for c in "uv")
    differ = {c: (F.col(c) != F.col(f"{c}_low")) | (F.col(c) != F.col(f"{c}_high")) for c in "uv"}
    one = F.col("x.p") == F.col("x.q")
    asks = (F.col("low") < F.col("at")) & (one | differ["u"] & differ["v"])
    asked = F.col("owner") & (F.col("owners") > FEW) & (one | (F.col("others") > 0) | u & v)
    met = keyed.join(told.filter("owners > 0"), "key").filter(asks | asked)
    return met.select("key", "at", "x", "own", "owner", "owners", "low", "high")


def _ends() -> dict[str, Column]:
    """Ends of the parts that hold edits, in parts."""
    p, q = F.col("x.p"), F.col("x.q")
    return {"p0": p, "p1": p + 1, "q0": q, "q1": q + 1}


def dedup_lines(docs: DataFrame, text: str = "text", edits: int = 2, least: int = 24) -> DataFrame:
    """The columns of docs with `kept` (text without the lines that go), n_lines, n_copies, n_near.

    Earlier means smaller doc_id (null first), then place in the text. n_copies lines equal an earlier
    one, n_near others lie within `edits` edits of an earlier one. Blank lines stay and count in n_lines
    only. Lines shorter than `least` go only if they are equal. A null text is empty; rows with the same
    doc_id and text are one document and get the same result. An empty table gives an empty one.
    """
    if least <= 2 * edits:
        raise ValueError("lines must be longer than twice the number of edits")
    # texts move once, to the key of their document; places of lines meet them there
    doc = F.coalesce("doc_id", F.lit(NAMELESS)).alias("doc")
    texts = docs.select(doc, whole_text(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    lines = texts.select(*KEY, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    at = F.struct(*KEY, "place").alias("at")
    hashed = lines.filter(~_blank(F.col("line"))).select(line_id(F.col("line")).alias("id"), F.xxhash64("line", F.lit(1)).alias("more"), at)
    firsts = cut_lineage(hashed.groupBy("id", "more").agg(F.min("at").alias("at")).select("id", "at"))
    placed = firsts.select("at.*").groupBy(*KEY).agg(F.collect_list("place").alias("first"))
    once = W.partitionBy(*KEY).orderBy(*KEY)
    single = _with_places(texts, placed, "first").withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    fresh = single.select(F.explode(_picked(F.col("first"))).alias("line")).withColumn("n", F.length("line"))
    pairs, crowded = near_links(fresh.filter(F.col("n") >= least).select(line_id(F.col("line")).alias("id"), "line", "n"), edits)
    a, b = (firsts.select(F.col("id").alias(x), F.col("at").alias(f"at_{x}")) for x in "ab")
    located = pairs.join(a, "a").join(b, "b").select(F.least("at_a", "at_b").alias("at_a"), F.greatest("at_a", "at_b").alias("at_b"))
    if not crowded.isEmpty():
        meeting = _lines_at(texts, firsts.join(crowded, "id").select("at")).withColumn("n", F.length("line"))
        located = located.union(crowded_links(cut_lineage(meeting), edits)).distinct()
    near = _verified(located, texts, edits)
    late = near.select("late.*").distinct().groupBy(*KEY).agg(F.collect_list("place").alias("near"))
    nothing = F.array().cast("array<int>")
    told = _with_places(single, late, "near")
    told = told.withColumns({"first": F.coalesce("first", nothing), "near": F.coalesce("near", nothing)})

    def result(own: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: _blank(F.get(own, i)))
        stay = F.sort_array(F.concat(blank, F.array_except("first", "near")))
        return F.struct(
            F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n").alias("kept"),
            F.size(own).alias("n_lines"),
            (F.size(own) - F.size(blank) - F.size("first")).alias("n_copies"),
            F.size("near").alias("n_near"),
        )

    told = told.select(*KEY, "text", let(F.split("text", "\n"), result).alias("x"))
    # the other columns go without the text, which is the same for all rows of a document
    others = F.struct(*(c for c in docs.columns if c not in (*RESULTS, text)), F.col(text).isNull().alias("_")).alias("row")
    rows = docs.select(doc, F.xxhash64(whole_text(text)).alias("digest"), others).join(told, KEY)
    given = F.when(~F.col("row")["_"], F.col("text")).alias(text)
    kept = [given if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS]
    return rows.select(*kept, "x.*")


def _lines_at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(at) distinct places -> (at, line)."""
    once = texts.join(places.select("at", "at.*"), KEY)
    return once.select("at", F.get(F.split("text", "\n"), F.col("place")).alias("line")).dropDuplicates(["at"])


def _verified(located: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Distinct pairs of places, at_a before at_b -> late: at_b of each pair within `edits` edits."""
    sides = F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"at_{x}").alias("at")) for x in "ab"))
    wanted = located.select("at_a", "at_b", F.explode(sides).alias("x")).select("at_a", "at_b", "x.side", "x.at.*")
    found = texts.join(wanted, KEY).select("at_a", "at_b", "side", F.get(F.split("text", "\n"), F.col("place")).alias("line"))
    lines = found.groupBy("at_a", "at_b").agg(*(F.max(F.when(F.col("side") == x, F.col("line"))).alias(x) for x in "ab"))
    close = (F.abs(F.length("a") - F.length("b")) <= edits) & (_apart(F.col("a"), F.col("b")) <= 2 * edits)
    near = lines.filter(F.when(close, banded_distance(F.col("a"), F.col("b"), edits) <= edits).otherwise(False))
    return near.select(F.col("at_b").alias("late"))


def _with_places(texts: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """texts with the array of places of their document, null if it has none."""
    return texts.join(places.select(*KEY, name), KEY, "left")


def _picked(places: Column) -> Column:
    """The lines at some places."""
    return let(F.split("text", "\n"), lambda own: F.transform(places, lambda p: F.get(own, p)))
