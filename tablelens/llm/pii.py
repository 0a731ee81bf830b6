"""Personal data: wide generators of overlapping candidate spans, and boosted trees that choose among them.

Four base patterns are always redacted. Beyond them generators propose what might be the same things
written otherwise. Trees judge each candidate by its format and its surroundings. They learn from the
base matches of all documents, as they stand and rewritten in looser ways, against candidates that
touch no base match and other cuts of the rewritten ones; each kind's threshold is set on rows the trees have not seen.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.functions.columns import quoted
from tablelens.llm.boosting import SHARES, Cells, Grown, Trees, added, codes_of, grow, sums_of, valued
from tablelens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: One in so many documents is kept for thresholds, and the precision a threshold must reach there.
KEPT, PRECISION = 3, 0.95
#: Characters of context on each side.
AROUND = 24
#: Candidates judged at a time.
JUDGED = 20_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does: if it fails there, it fails from inside the run too.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
GROUP = re.compile(r"[0-9]+")

AT = re.compile(r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s?@\s?|\sat\s)", re.I)
LOOSE_LOCAL = re.compile(r"[\w.%+-]{1,64}$")
LOOSE_DOMAIN = re.compile(r"[\w-]{1,63}(?:(?:\.|\s?[\[({<]?\s?\bdot\b\s?[\])}>]?\s?)[\w-]{2,63}){1,4}", re.I)
NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20()./_:-]{0,3}[0-9])+")
CUE = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|account|pay", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax", re.I),
}


def digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, in time that does not grow with the square of a run of letters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            end = match.end()
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid matches of the base patterns by kind, then place."""
    found = [("email", *span) for span in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 13 <= len(number) <= 19 and luhn(number):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return found


def _wide(text: str) -> Iterator[tuple[str, int, int]]:
    for m in AT.finditer(text):
        left, right = LOOSE_LOCAL.search(text, max(0, m.start() - 64), m.start()), LOOSE_DOMAIN.match(text, m.end())
        if left and right:
            yield "email", left.start(), right.end()
    for m in NUMBER.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):  # 19 groups at most, as each has a digit
                end = groups[j][1]
                n += end - groups[j][0]
                if n > 19:
                    break
                if j == i + 3 and n <= 12 and text.count(".", start, end) == 3:
                    yield "ip", start, end
                if n >= 12:
                    yield "card", start, end
                if 7 <= n <= 15:
                    opened = start - 1 if start and text[start - 1] in "+(" else start
                    opened = opened - 1 if opened and text[opened - 1] == "+" and text[opened] == "(" else opened
                    yield "phone", opened, end


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What may be personal data, widely; spans may overlap and one span may have several kinds.

    Of a run of digits and signs each window of whole groups whose digits fit a kind is one.
    """
    return list(_wide(text))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a candidate and its surroundings."""
    body, number = text[start:end], digits(text[start:end])
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    groups = [g for g in NOT_DIGIT.split(body) if g]
    tail = re.split(r"\.|\bdot\b", body)[-1].strip(" ])}>") if kind == "email" else ""
    return [
        len(body),
        len(number),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len({c for c in body if not c.isalnum()}),
        sum(not c.isalnum() for c in body),
        body.startswith("+"),
        "(" in body,
        "@" in body,
        " at " in body.lower(),
        " " in body,
        len(tail),
        tail.isalpha(),
        len(set(number)),
        bool(number) and luhn(number),
        all(map(_small, groups)) if len(groups) == 4 else False,
        number[:1] in "3456" and bool(number),
        before[-1:].isalnum(),
        after[:1].isalnum(),
        before[-1:].isspace() or not before,
        after[:1].isspace() or not after,
        before[-1:] in ".,:/-_#=" and bool(before),
        after[:1] in ":/-_%$" and bool(after),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
        CUE[kind].search(before) is not None,
    ]


FEATURES = len(features("", "email", 0, 0))


def _rewritten(text: str, kind: str, start: int, end: int, pick: int) -> tuple[str, int, int]:
    """The text with a base match written in a looser way, and where it is then."""
    body = text[start:end]
    if kind == "email":
        local, domain = body.rsplit("@", 1)
        body = (f"{local} at {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} @ {domain}")[pick % 3]
    elif kind == "card":
        n = digits(body)
        body = ("".join(n), " ".join(n[i : i + 4] for i in range(0, len(n), 4)), ".".join(n[i : i + 4] for i in range(0, len(n), 4)))[pick % 3]
    elif kind == "phone":
        n = digits(body)
        body = (f"{n[:-7]}-{n[-7:-4]}-{n[-4:]}", f"({n[:-7]}) {n[-7:-4]} {n[-4:]}", f"{n[:-7]}.{n[-7:-4]}.{n[-4:]}")[pick % 3]
    return text[:start] + body + text[end:], start, start + len(body)


def form(kind: str, body: str) -> str:
    """How something is written, whatever its letters, signs and first digits; empty if no rewriting gives it."""
    if kind == "email":
        at, parts = AT.search(body), re.split(r"\.|\bdot\b", body)
        bare = re.sub(r"\s", "", at.group().lower()) if at else ""
        return f"{bare}.{parts[-1].strip(' ])}>').lower()}" if bare and len(parts) > 1 else ""
    groups = [str(len(g)) for g in GROUP.findall(body)]
    if kind == "card":
        return "-".join(groups) if luhn(digits(body)) else ""
    return "-".join(["n", *groups[1:]]) if kind == "phone" and len(groups) > 1 else ""


def examples(text: str) -> Iterator[tuple[str, int, list[float], str]]:
    """(kind, label, features, form): base matches as they are, rewritten, and side by side, and what they are not.

    Not personal data are other windows of numbers over a rewritten match, and candidates that touch no base
    match. Only rewritten matches and the latter, which may be personal data after all, have a form.
    """
    base = base_spans(text)
    for i, (kind, start, end) in enumerate(base):
        yield kind, 1, features(text, kind, start, end), ""
        near = slice(max(0, start - 2 * AROUND), end + 2 * AROUND)
        shift, pick = start - near.start, crc32(text[near].encode()) + i
        other, s, e = _rewritten(text[near], kind, shift, shift + end - start, pick)
        yield kind, 1, features(other, kind, s, e), form(kind, other[s:e])
        if kind in ("card", "phone"):
            yield from _windows(other, kind, [(s, e)])
            between = (" ", " / ", ", ")[pick // 3 % 3]
            twice, then = other[:e] + between + other[s:], e + len(between)
            both = [(s, e), (then, then + e - s)]
            for span in both:
                yield kind, 1, features(twice, kind, *span), ""
            yield from _windows(twice, kind, both)
    for kind, start, end in _free(_wide(text), base):
        yield kind, 0, features(text, kind, start, end), form(kind, text[start:end])


def _windows(text: str, kind: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, list[float], str]]:
    """Windows of numbers that overlap the spans, which are of that kind, but are none of them."""
    for k, start, end in _wide(text):
        if k != "email" and (k != kind or (start, end) not in spans) and any(s < end and start < e for s, e in spans):
            yield k, 0, features(text, k, start, end), ""


def _free(found: Iterable[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Candidates that overlap no base span."""
    starts = np.array(sorted(s for _, s, _ in base))
    reach = np.maximum.accumulate([e for _, _, e in sorted(base, key=lambda x: x[1])]) if base else starts
    for kind, start, end in found:
        before = np.searchsorted(starts, end)
        if not before or reach[before - 1] <= start:
            yield kind, start, end


@dataclass(frozen=True)
class Model:
    trees: dict[str, Trees]
    thresholds: dict[str, float]


#: Steps of the probability that are counted apart, and cells that a task should have to be worth its start.
STEPS, CELLS = 1 << 12, 50_000


def _thresholds(judged: DataFrame) -> dict[str, float]:
    """For each kind the least probability from which on the share of real ones is high enough; over 1 if none is.

    judged: (kind, label, p). The share is smoothed by one false candidate, so that a few lucky ones do not set it.
    """
    sums = F.sum("n").alias("n"), F.sum("ones").alias("ones")
    counted = judged.groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    counted = cut_lineage(counted.withColumn("step", F.floor(F.col("p") * STEPS).cast("int")))
    # steps are few; within a step its probabilities are put in order by themselves
    above = W.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1)
    steps = counted.groupBy("kind", "step").agg(*sums)
    steps = steps.select("kind", "step", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "ones")))
    here = W.partitionBy("kind", "step").orderBy(F.desc("p"))
    told = counted.join(steps, ["kind", "step"])
    told = told.select("kind", "p", "n", "ones", *((F.sum(c).over(here) + F.col(f"{c}_above")).alias(f"{c}_to") for c in ("n", "ones")))
    # of equally likely ones the false stand first, so the share is highest at the first or at the last of them
    n, ones = F.col("n_to") - F.col("n"), F.col("ones_to") - F.col("ones")
    first = (ones + (F.col("n") == F.col("ones")).cast("int")) / (n + 2)
    share = F.greatest(first, F.col("ones_to") / (F.col("n_to") + 1))
    enough = told.filter(share >= PRECISION).groupBy("kind").agg(F.min("p").alias("p"))
    return dict.fromkeys(KINDS, 1.1) | {r["kind"]: r["p"] for r in enough.collect()}


def learn(docs: DataFrame) -> Model:
    """Trees and thresholds for each kind from all documents.

    Examples, their cells and what a threshold is set by are made and counted by Spark, once each: copies of a document
    add nothing. The driver sees cuts of features, sums by node, feature and code, and the thresholds.
    Candidates written as a rewritten match is may well be personal data: they are neither learned from as negatives
    nor counted as false. Null and empty texts give no examples; without examples no span is added.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 64):
                texts = batch["text"].iloc[first : first + 64]
                found = [(k, y, x, f, crc32((t or "").encode()) % KEPT == 0) for t in texts for k, y, x, f in examples(t or "")]
                yield pd.DataFrame(found, columns=["kind", "label", "x", "form", "kept"])

    schema = "kind string, label int, x array<double>, form string, kept boolean"
    held = cut_lineage(docs.select("text").mapInPandas(make, schema).distinct())
    loose = held.filter("label = 1 and form != ''").select("kind", "form").distinct()
    columns = ["kind", "label", "x", "kept"]
    sure = held.filter("label = 0").join(loose, ["kind", "form"], "left_anti").select(columns)
    sure = cut_lineage(sure.unionByName(held.filter("label = 1").select(columns)))
    trees = _trees(sure.filter("not kept").select("kind", "label", "x"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                p = trees[kind].predict(np.array(part["x"].tolist(), float))
                yield pd.DataFrame({"kind": kind, "label": part["label"], "p": p})

    judged = sure.filter("kept").select("kind", "label", "x").mapInPandas(judge, "kind string, label int, p double")
    return Model(trees, _thresholds(judged))


def _trees(rows: DataFrame) -> dict[str, Trees]:
    """Trees for each kind from (kind, label, x), the rows of all kinds in the same passes over their cells."""
    quantiles = [F.percentile(F.get("x", F.lit(i)), F.lit(SHARES.tolist())).alias(f"q{i}") for i in range(FEATURES)]
    shape = rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *quantiles).collect()
    cuts = {r["kind"]: [np.unique(r[f"q{i}"]) for i in range(FEATURES)] for r in shape}
    counts = dict.fromkeys(KINDS, (0, 0)) | {r["kind"]: (r["n"], r["ones"]) for r in shape}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                codes = codes_of(np.array(part["x"].tolist(), float), cuts[kind])
                yield pd.DataFrame({"kind": kind, "label": part["label"], "codes": [c.tobytes() for c in codes]})

    coded = rows.mapInPandas(code, "kind string, label int, codes binary").groupBy("kind", "label", "codes").agg(F.count("*").alias("n"))
    coded = cut_lineage(coded)
    blocks = coded.repartition(max(1, -(-coded.count() // CELLS))).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = blocks.getNumPartitions()

    def passed(models: dict[str, Grown]) -> dict[str, np.ndarray]:
        sums = blocks.map(lambda held: {k: sums_of(held[k], m) for k, m in models.items() if k in held})
        return sums.treeReduce(lambda a, b: added([a, b]), 2 if tasks > 64 else 1)

    try:
        grown = grow(counts, passed)
    finally:
        blocks.unpersist()
    return {k: valued(t, cuts.get(k, [])) for k, t in grown.items()}


def _blocks(cells: Iterable) -> Iterator[dict[str, Cells]]:
    """The cells (kind, label, codes, n) of a partition by kind."""
    by_kind: dict[str, list] = {}
    for r in cells:
        by_kind.setdefault(r["kind"], []).append((r["codes"], r["label"], r["n"]))
    out = {}
    for kind, rows in by_kind.items():
        codes, y, n = zip(*sorted(rows), strict=True)
        out[kind] = Cells(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, FEATURES), np.array(y, float), np.array(n, float))
    yield out


def all_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones: chosen by falling probability, overlapping none."""
    base = [base_spans(t) for t in texts]
    wide = ((i, *w) for i, t in enumerate(texts) for w in _free(_wide(t), base[i]))
    added: list[list] = [[] for _ in texts]
    chosen = []
    while part := list(islice(wide, JUDGED)):
        for kind in KINDS:
            own = [w for w in part if w[1] == kind]
            if own:
                p = model.trees[kind].predict(np.array([features(texts[i], k, s, e) for i, k, s, e in own], float))
                chosen += [(-x, *w) for x, w in zip(p, own, strict=True) if x >= model.thresholds[kind]]
    taken: list[list] = [[] for _ in texts]  # apart from one another, so sorted by both ends
    for _, i, kind, start, end in sorted(chosen, key=lambda x: (x[0], x[1], KINDS.index(x[2]), x[3] - x[4], x[3])):
        at = bisect(taken[i], (start, end))
        if (not at or taken[i][at - 1][1] <= start) and (at == len(taken[i]) or end <= taken[i][at][0]):
            taken[i].insert(at, (start, end))
            added[i].append((kind, start, end))
    return list(zip(base, added, strict=True))


SPAN = "struct<kind:string,start:int,end:int>"


def find(text: Column, model: Model) -> Column:
    """struct<base, spans>: arrays of (kind, start, end) in code points, end exclusive, by kind as listed, then start.

    `spans` holds the base ones and those that the model adds. Null and empty texts have none.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = []
            for first in range(0, len(texts), 256):
                made += all_spans([t or "" for t in texts.iloc[first : first + 256]], model)
            rank = {k: i for i, k in enumerate(KINDS)}
            told = [(b, sorted(b + a, key=lambda x: (rank[x[0]], *x[1:]))) for b, a in made]
            shown = [[[{"kind": k, "start": s, "end": e} for k, s, e in side] for side in pair] for pair in told]
            yield pd.DataFrame({"base": [x[0] for x in shown], "spans": [x[1] for x in shown]})

    return F.pandas_udf(run, f"base array<{SPAN}>, spans array<{SPAN}>")(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (in any order; overlapping ones joined by the later start) shown as [KIND]."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        between = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        shown = F.when(s["start"] < state["at"], "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.concat(state["done"], between, shown).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, empty, step, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1, F.length(text))))


def find_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of docs, which hold `text`, with `base` and `spans` (see `find`), which replace columns of these names.

    The model is learned if not given. Null and empty texts have no spans, repeated rows equal ones, no rows give no rows.
    """
    model = learn(docs) if model is None else model
    names = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    # The given columns go by number meanwhile, so that none of them meets a name used here.
    found = docs.select(*(quoted(c).alias(f"given{i}") for i, c in enumerate(names)), find(F.col("text"), model).alias("found"))
    return found.select(*(F.col(f"given{i}").alias(c) for i, c in enumerate(names)), "found.base", "found.spans")
