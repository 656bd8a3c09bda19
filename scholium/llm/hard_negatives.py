"""Hard-negative mining by dual-tree search over inner products.

Vectors become whole numbers, floor(256 x), so scores are exact. They are
dealt to shards by a hash; a shard has ``SHARD`` vectors, or the square root of the table's rows times ``GROWTH``
if that is more, as far as ``MOST`` bytes hold. A search is a set of
questions (an anchor's vector, a range of scores, the same label or another, how many); every shard is asked
in blocks of ``BLOCK`` questions, and the shards' best are merged.

Within a shard candidates and questions each have a tree: at its root the labels part,
below that rows part along a direction of spread; a node is a range of rows with a
centre, a radius and a largest norm. For a pair of nodes these bound every inner product between
them. A pair is left out at once, for all questions of its node, where the labels can't
match, where the upper bound is below what each question has already found (or its
range's lower end), or the lower bound is above all their ranges. Of the rest the more
promising half is looked at first, and pairs of leaves are scored exactly, by one matrix product.

First each anchor asks for its positives; then each different score of a positive
asks for the negatives in its range. Work is the questions times the shards that
pruning can't spare; on vectors without clusters bounds of many dimensions are wide and most pairs of
leaves are scored.

Defined results: rows with a null vec_id or label, a null or empty vector, or a null
or non-finite component take no part, nor do rows whose whole numbers have squares
that sum to 2**55 or more, whose scores in percent a long can't hold; vectors of another length than the anchor's
are no candidates; rows that repeat wholly count once, and no row with the anchor's vec_id is
its candidate; an anchor without positives, or a positive without
negatives in range, gives no row; an empty table gives none; further columns are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD = 16_384
GROWTH = 32
MOST = 256 << 20
BLOCK = 2_048
LEAF = 128
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
EXACT = 1 << 52
LEAST, MOST_SCORE = -(1 << 62), 1 << 62


class Tree:
    """Rows in an order in which each node is a range of them."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(label, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(label[self.order]) != 0]).tolist() + [len(label)]
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, children's numbers (-1: a leaf)
        work = x.astype(np.float64)
        tops = [self._split(work, a, b, leaf) for a, b in zip(edges, edges[1:], strict=False)]
        while len(tops) > 1:  # the labels' trees meet two by two, so neighbours stay ranges
            tops = [self._node(self.nodes[p][0], self.nodes[q][1], p, q) for p, q in zip(tops[::2], tops[1::2], strict=False)] + tops[len(tops) & ~1 :]
        self.root = tops[0]
        self.x, self.label = x[self.order], label[self.order]
        work = work[self.order]
        norm = np.sqrt(np.einsum("ij,ij->i", work, work))
        n = len(self.nodes)
        self.centre, self.radius, self.norm, self.centre_norm = np.empty((n, x.shape[1])), np.empty(n), np.empty(n), np.empty(n)
        self.low, self.high = np.empty(n, np.int64), np.empty(n, np.int64)
        for i, (a, b, _, _) in enumerate(self.nodes):
            self.centre[i] = work[a:b].mean(axis=0)
            self.radius[i] = np.sqrt(((work[a:b] - self.centre[i]) ** 2).sum(axis=1).max())
            self.norm[i], self.centre_norm[i] = norm[a:b].max(), np.sqrt((self.centre[i] ** 2).sum())
            self.low[i], self.high[i] = self.label[a], self.label[b - 1]

    def _node(self, a: int, b: int, left: int, right: int) -> int:
        self.nodes.append((a, b, left, right))
        return len(self.nodes) - 1

    def _split(self, x: np.ndarray, a: int, b: int, leaf: int) -> int:
        """The node over order[a:b], parted midway between the row farthest from the centre and the one farthest from that; by halves where that leaves less than an eighth."""
        if b - a <= leaf:
            return self._node(a, b, -1, -1)
        rows = x[self.order[a:b]]
        one = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
        along = rows @ (other - one)
        half = int((along <= (along.min() + along.max()) / 2).sum())
        if min(half, b - a - half) < (b - a) / 8:
            half = (b - a) // 2
        self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
        left, right = self._split(x, a, a + half, leaf), self._split(x, a + half, b, leaf)
        return self._node(a, b, left, right)


class Questions:
    """Vectors with a range of scores, a label that candidates must have or must not have, and the best found so far."""

    def __init__(self, number, vec_id, x, label, low, high, same: bool, top: int, leaf: int = LEAF):
        self.tree = Tree(x, label, leaf)
        o = self.tree.order
        self.number, self.vec_id, self.low, self.high = number[o], vec_id[o], low[o], high[o]
        self.same, self.top = same, top
        self.least = self.low.copy()  # a candidate must reach this
        self.score = np.full((len(o), top), LEAST, np.int64)
        self.found = np.full((len(o), top), np.iinfo(np.int64).max, np.int64)

    def take(self, rows: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Enter candidates (row, score, vec_id), the better first and of equal ones the smaller vec_id."""
        some, place = np.unique(rows, return_inverse=True)
        place = np.r_[place, np.repeat(np.arange(len(some)), self.top)]
        score, vec_id = np.r_[score, self.score[some].ravel()], np.r_[vec_id, self.found[some].ravel()]
        order = np.lexsort((vec_id, -score, place))
        place, score, vec_id = place[order], score[order], vec_id[order]
        first = np.searchsorted(place, np.arange(len(some)))
        at = first[:, None] + np.arange(self.top)
        self.score[some], self.found[some] = score[at], vec_id[at]
        self.least[some] = np.maximum(self.low[some], self.score[some, -1])


def search(questions: Questions, candidates: Tree, ids: np.ndarray) -> dict[str, int]:
    """Fills the questions with the best of the candidates (``ids`` in the tree's order); how many pairs of nodes were seen, left out and scored."""
    q, c = questions.tree, candidates
    done = {"seen": 0, "left_out": 0, "scored": 0}
    small = float(q.norm[q.root]) * float(c.norm[c.root]) < EXACT
    qx, cx = (t.x.astype(np.float64) if small else t.x for t in (q, c))

    def bound(i: int, j: int) -> tuple[float, float]:
        centre = float(q.centre[i] @ c.centre[j])
        reach = q.radius[i] * c.centre_norm[j] + c.radius[j] * q.centre_norm[i] + q.radius[i] * c.radius[j]
        slack = 1 + 1e-9 * q.norm[i] * c.norm[j]  # rounding of the bounds themselves
        most = float(q.norm[i] * c.norm[j])
        return max(centre - reach, -most) - slack, min(centre + reach, most) + slack

    stack = [(bound(q.root, c.root), q.root, c.root)]
    while stack:
        (low, high), i, j = stack.pop()
        done["seen"] += 1
        a, b, left, right = q.nodes[i]
        e, f, fore, aft = c.nodes[j]
        if questions.same:
            unfit = q.high[i] < c.low[j] or c.high[j] < q.low[i]
        else:
            unfit = q.low[i] == q.high[i] == c.low[j] == c.high[j]
        if unfit or high < questions.least[a:b].min() or low > questions.high[a:b].max():
            done["left_out"] += 1
            continue
        if left < 0 and fore < 0:
            done["scored"] += 1
            scores = qx[a:b] @ cx[e:f].T
            scores = scores.astype(np.int64) if small else scores
            fits = (scores >= questions.least[a:b, None]) & (scores <= questions.high[a:b, None])
            fits &= (q.label[a:b, None] == c.label[None, e:f]) == questions.same
            fits &= questions.vec_id[a:b, None] != ids[None, e:f]
            row, column = np.nonzero(fits)
            if len(row):
                questions.take(row + a, scores[row, column], ids[e:f][column])
            continue
        if left >= 0 and (fore < 0 or b - a > f - e):
            pairs = [(bound(k, j), k, j) for k in (left, right)]
        else:
            pairs = [(bound(i, k), i, k) for k in (fore, aft)]
        stack += sorted(pairs, key=lambda p: p[0][1])  # the more promising one is on top
    return done


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, x, dim) of the rows that take part, each once; x are whole numbers."""
    raw = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(raw, lambda x: F.floor(x * scale).cast("double")).alias("x"), raw.alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0))
    rows = rows.where(~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**40)))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x) < 2.0**55)
    return rows.select("vec_id", "label", F.col("x").cast("array<long>").alias("x"), F.size("x").alias("dim")).distinct()


def shard_size(rows: int, dim: int) -> int:
    return max(1, min(max(SHARD, int(GROWTH * rows**0.5)), MOST // (24 * dim + 32)))


def asked(rows: DataFrame, questions: DataFrame, same: bool, top: int, shards: int, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(question, vec_id, score): each shard's best for ``questions`` (question, vec_id, label, x, dim, low, high)."""
    number = F.pmod(F.xxhash64("vec_id", "label"), F.lit(shards)).cast("int")
    here = rows.select(number.alias("shard"), "dim", F.lit(None).cast("long").alias("question"), "vec_id", "label", "x", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    there = questions.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "question", "vec_id", "label", "x", "low", "high")
    lined = here.unionByName(there).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", F.col("question").asc_nulls_first())

    def find(batches):
        now, tree, ids, held, waiting = None, None, None, [], []

        def answers():
            if tree is None or not waiting:
                return
            q, vec_id, label, x, low, high = (np.concatenate(part) for part in zip(*waiting, strict=True))
            waiting.clear()
            for at in range(0, len(q), block):
                s = slice(at, at + block)
                some = Questions(q[s], vec_id[s], x[s], label[s], low[s], high[s], same, top, leaf)
                search(some, tree, ids)
                row, place = np.nonzero(some.found != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(some.number[row]), pa.array(some.found[row, place]), pa.array(some.score[row, place])], ["question", "vec_id", "score"])

        def grown():
            nonlocal tree, ids
            if tree is None and held:
                vec_id, label, x = (np.concatenate(part) for part in zip(*held, strict=True))
                held.clear()
                tree = Tree(x, label, leaf)
                ids = vec_id[tree.order]

        for batch in batches:
            shard, dim = (batch.column(i).to_numpy() for i in (0, 1))
            question = batch.column(2)
            asks = np.asarray(question.is_valid())
            turns = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(asks.astype(int)) != 0)]) if len(shard) else []
            for a, b in zip(turns, [*turns[1:], len(shard)], strict=True):
                if (shard[a], dim[a]) != now:
                    grown()
                    yield from answers()
                    now, tree = (shard[a], dim[a]), None
                    held.clear()
                    waiting.clear()
                part = batch.slice(a, b - a)
                vec_id, label = (part.column(i).to_numpy() for i in (3, 4))
                x = part.column(5).flatten().to_numpy().reshape(b - a, -1)
                if not asks[a]:
                    held.append((vec_id, label, x))
                    continue
                grown()
                waiting.append((part.column(2).to_numpy(), vec_id, label, x, part.column(6).to_numpy(), part.column(7).to_numpy()))
                if sum(len(w[0]) for w in waiting) >= block:
                    yield from answers()
        grown()
        yield from answers()

    return lined.mapInArrow(find, "question long, vec_id long, score long")


def _best(found: DataFrame, top: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, shard: int | None = None, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors``, rows as ``usable`` gives them.

    A negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    shards = max(1, -(-size.n // (shard or shard_size(size.n, size.dim or 1))))
    rows, _ = written(rows, "mine-rows")
    anchors, _ = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "mine-anchors")
    first = anchors.select(F.col("anchor").alias("question"), "vec_id", "label", "x", "dim", F.lit(LEAST + 1).alias("low"), F.lit(MOST_SCORE).alias("high"))
    near = _best(asked(rows, first, True, positives, shards, leaf).distinct(), positives, "question")
    near, _ = written(near.select(F.col("question").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "mine-positives")

    least = F.call_function("div", F.col("positive_score") * low + 99, F.lit(100).cast("long"))
    most = F.call_function("div", F.col("positive_score") * high, F.lit(100).cast("long"))
    ranges = near.where("positive_score >= 0").select("anchor", "positive_score").distinct().join(anchors, "anchor")
    ranges, _ = written(ranges.withColumn("question", F.monotonically_increasing_id()).withColumns({"low": least, "high": most}), "mine-ranges")
    hard = _best(asked(rows, ranges, False, negatives, shards, leaf).distinct(), negatives, "question")
    hard = hard.select("question", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(ranges.select("question", "anchor", "positive_score", F.col("vec_id").alias("anchor_id")), ["anchor", "positive_score"]).join(hard, "question")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved by one first; anchors are the ids divisible by 50."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return mined(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::bigint as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 50 = 0),
p as (select * from (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same) where n <= 5),
g as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from g where rank <= 3
"""
