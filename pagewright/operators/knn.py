"""Exact nearest neighbours of a table of questions in a table of chunks.

Every chunk is compared with every question, as the semantics demand, but no pair becomes a
row. Blocks of vectors meet inside a task, where a matrix product yields approximate
distances, the near ones are measured again element by element in the documented order, and
only the best ``k`` per question leave the task. A window keeps the best ``k`` overall;
Spark limits it per partition before the shuffle.

Question vectors are broadcast when their number and size show that they fit. Otherwise both
sides are packed into pieces of bounded size, a row each, and a grid of tasks meets its share of
the one with its share of the other. A task keeps the best ``k`` of each of its questions, whose
last distance screens the pieces that follow; what moves afterwards is the best ``k`` of every
task. Questions of equal vectors are compared once. Nothing goes through the driver.

Equal distances are ordered by document, sequence and chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.session import materialize

KEYS = ["document_fingerprint", "sequence", "chunk_id"]
ORDER = ["distance", *KEYS]
_HITS = "question_id long, chunk_id string, document_fingerprint string, sequence int, distance double"
_HIT_ARROW = pa.schema(
    [
        ("question_id", pa.int64()),
        ("chunk_id", pa.string()),
        ("document_fingerprint", pa.string()),
        ("sequence", pa.int32()),
        ("distance", pa.float64()),
    ]
)
_TILE_CELLS = 4_000_000
#: Questions of a piece that are screened at a time, so that their products stay in the cache.
_SCREEN_ROWS = 256
_PIECE_ROWS = 2048
_PIECE_BYTES = 1024 * 1024
_TASK_BYTES = 64 * 1024 * 1024


def _to_unit(v: np.ndarray) -> np.ndarray:
    """Scaled to length one, measured in double precision; zero stays zero."""
    length = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))[:, None]
    return (v / np.where(length == 0, 1.0, length)).astype(np.float32)


def _approximate(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances in single precision and twice a bound on their error.

    An inner product of d terms is off by less than d roundings of the vectors' lengths.
    Vectors come as units for the cosine, where a zero vector rightly gets distance 1.
    """
    rounding = 4.0 * (q.shape[1] + 4) * np.finfo(np.float32).eps
    dots = q @ c.T
    if metric == "cosine":
        return 1 - dots, 2 * rounding
    q2, c2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    q_most, c_most = float(np.nanmax(q2, initial=0.0)), float(np.nanmax(c2, initial=0.0))
    if metric == "ip":
        return 1 - dots, 2 * rounding * max(1.0, np.sqrt(q_most) * np.sqrt(c_most))
    reach = (np.sqrt(q_most) + np.sqrt(c_most)) ** 2
    return q2[:, None] + c2[None, :] - 2 * dots, 2 * rounding * max(1.0, reach)


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row pairs, summed from left to right."""
    dots, q2, c2, gaps = (np.zeros(len(q)) for _ in range(4))
    for i in range(q.shape[1]):
        a, b = q[:, i], c[:, i]
        if metric == "l2":
            gaps += (a - b) * (a - b)
            continue
        dots += a * b
        if metric == "cosine":
            q2 += a * a
            c2 += b * b
    if metric == "l2":
        return gaps
    if metric == "ip":
        return 1.0 - dots
    scale = np.sqrt(q2) * np.sqrt(c2)
    return np.where(scale == 0, 1.0, 1.0 - dots / np.where(scale == 0, 1.0, scale))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows, taken from the values that lie behind each other."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    width = len(flat) // len(vectors)
    if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of one length are needed; see validate_vectors")
    return flat.reshape(len(vectors), width)


def _first_copies(vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of rows that at most ``most - 1`` equal rows precede."""
    if not vectors.shape[1]:
        return np.arange(min(most, len(vectors)))
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel()
    numbers = np.unique(rows, return_inverse=True)[1]
    return np.flatnonzero(pd.Series(numbers).groupby(numbers).cumcount().to_numpy() < most)


def nearest_in_block(
    question_ids: np.ndarray,
    questions: np.ndarray,
    chunks: pd.DataFrame,
    vectors: np.ndarray,
    k: int,
    metric: str,
    exclude: bool = False,
) -> pd.DataFrame:
    """The best ``k`` chunks of one block for each question, in the documented order. ``chunks``
    are the keys of the rows of ``vectors``."""
    chunks = chunks.reset_index(drop=True).sort_values(KEYS, kind="stable")
    vectors = vectors[chunks.index]
    if not exclude:
        # Copies of one vector tie for every question, so its first k copies are enough.
        first = _first_copies(vectors, k)
        chunks, vectors = chunks.iloc[first], vectors[first]
    chunks = chunks.reset_index(drop=True)
    own = chunks["question_id"].to_numpy() if exclude else None
    tile = max(1, _TILE_CELLS // len(chunks))
    compared = _to_unit(vectors) if metric == "cosine" else vectors
    found = []
    for start in range(0, len(questions), tile):
        q = questions[start : start + tile]
        ids = question_ids[start : start + tile]
        near, slack = _approximate(_to_unit(q) if metric == "cosine" else q, compared, metric)
        barred = ids[:, None] == own[None, :] if exclude else np.zeros(near.shape, dtype=bool)
        near[barred] = np.inf
        if near.shape[1] > k:
            # The k-th approximate distance bounds the true one up to rounding.
            limit = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + np.float32(slack)
        else:
            limit = np.full((len(q), 1), np.inf)
        # Written so that a distance that is not a number stays in and is reported later.
        row, col = np.nonzero(~(near > limit) & ~barred)
        distance = np.empty(len(row))
        for at in range(0, len(row), _TILE_CELLS // 64):
            part = slice(at, at + _TILE_CELLS // 64)
            distance[part] = _exact(
                q[row[part]].astype(np.float64), vectors[col[part]].astype(np.float64), metric
            )
        # Columns follow the tie-breakers, so (question, distance, column) is the full order.
        order = np.lexsort((col, distance, row))
        row, col, distance = row[order], col[order], distance[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        hit = chunks.iloc[col[keep]]
        found.append(
            pd.DataFrame(
                {
                    "question_id": ids[row[keep]],
                    "chunk_id": hit["chunk_id"].to_numpy(),
                    "document_fingerprint": hit["document_fingerprint"].to_numpy(),
                    "sequence": hit["sequence"].to_numpy(),
                    "distance": distance[keep],
                }
            )
        )
    return pd.concat(found, ignore_index=True)


def split_finite(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of questions whose distances are all finite, and the other questions with their
    error: ``question_id``, ``error_code``, ``error_status``."""
    bad = F.isnan("distance") | (F.abs("distance") == float("inf"))
    failed = hits.filter(bad).select("question_id").distinct()
    errors = failed.select("question_id", F.lit("INVALID_RETRIEVAL_DISTANCE").alias("error_code"), F.lit(502).alias("error_status"))
    return hits.join(failed, "question_id", "left_anti"), errors


def _require_finite(hits: DataFrame) -> DataFrame:
    bad = F.isnan("distance") | (F.abs("distance") == float("inf"))
    return hits.withColumn(
        "distance",
        F.when(bad, F.raise_error(F.lit("INVALID_RETRIEVAL_DISTANCE")).cast("double")).otherwise(F.col("distance")),
    )


def _corpus(chunks: DataFrame) -> DataFrame:
    names = [*KEYS, "embedding"] + (["question_id"] if "question_id" in chunks.columns else [])
    return chunks.select(*[F.col(n) for n in names]).withColumn("sequence", F.col("sequence").cast("int"))


def _by_broadcast(questions: DataFrame, corpus: DataFrame, k: int, metric: str, exclude: bool):
    """Hits of questions that fit on the driver and every executor, with their broadcast."""
    rows = questions.select("question_id", "embedding").toArrow().combine_chunks()
    ids = rows["question_id"].to_numpy().astype(np.int64)
    vectors = rows["embedding"].combine_chunks()
    shared = corpus.sparkSession.sparkContext.broadcast((ids, _matrix(vectors)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, asked = shared.value
        held, best = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.drop_columns(["embedding"]).to_pandas()
            best.append(nearest_in_block(question_ids, asked, keys, _matrix(batch["embedding"]), k, metric, exclude))
            held += len(best[-1])
            # Fold the per-batch results together before they pile up.
            if held > 2_000_000:
                best = [_best(pd.concat(best), k)]
                held = len(best[0])
        if best:
            yield from pa.Table.from_pandas(_best(pd.concat(best), k), _HIT_ARROW, preserve_index=False).to_batches(100_000)

    return corpus.mapInArrow(score, _HITS), shared


def _best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["question_id", *ORDER], kind="stable")
    return ordered.groupby("question_id", sort=False).head(k)


def _nearest(hits: DataFrame, k: int, order: list[str] = ORDER) -> DataFrame:
    """The best ``k`` hits per question. Arrow brings a NaN back as null, which would sort first."""
    hits = hits.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))
    nearest = Window.partitionBy("question_id").orderBy(*order)
    return hits.withColumn("_cut", F.row_number().over(nearest)).filter(F.col("_cut") <= k).drop("_cut")


def _pack_chunks(exclude: bool, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.take(pa.array(np.argsort(whole["number"].to_numpy(), kind="stable")))
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                own = batch["question_id"] if exclude else pa.nulls(0, pa.int64())
                columns = [
                    batch["number"].to_numpy().tobytes(),
                    _matrix(batch["embedding"]).tobytes(),
                    own.fill_null(0).to_numpy().tobytes(),
                    own.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                ]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in columns], ["numbers", "vectors", "own", "owned"])

    return run


def _pack_questions(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                columns = [batch["question_id"].to_numpy().astype(np.int64).tobytes(), _matrix(batch["embedding"]).tobytes()]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in columns], ["ids", "asked"])

    return run


_room: list[np.ndarray] = []


def _places(keep: np.ndarray) -> np.ndarray:
    """Places of the few cells that are true; eight cells are looked at as one word."""
    flat = keep.ravel()
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    at = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(even, len(flat))])
    return at[flat[at]]


def _longest(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.nanmax(np.einsum("ij,ij->i", vectors, vectors), initial=0.0)))


class _Piece:
    """Chunks of a piece, without copies that cannot be among the best ``k``."""

    def __init__(self, row: dict, k: int, metric: str, exclude: bool):
        self.numbers = np.frombuffer(row["numbers"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(self.numbers), -1)
        self.own = np.frombuffer(row["own"], np.int64)
        self.owned = np.frombuffer(row["owned"], bool)
        if not exclude:
            first = _first_copies(self.vectors, k)
            self.numbers, self.vectors = self.numbers[first], self.vectors[first]
        self.compared = _to_unit(self.vectors) if metric == "cosine" else self.vectors
        self.longest = _longest(self.vectors)

    def room(self, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Memory for a block of products and for one of decisions, used again by the next piece."""
        if len(_room) != 2 or _room[0].shape != shape:
            _room[:] = [np.empty(shape, np.float32), np.empty(shape, bool)]
        return _room[0], _room[1]


class _Asked:
    """Questions of a piece and the best ``k`` found so far, in order of distance and number.
    Places not filled yet hold NaN and the largest number, which come last."""

    def __init__(self, ids: bytes, vectors: bytes, k: int, metric: str):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float32).reshape(len(self.ids), -1)
        self.compared = _to_unit(self.vectors) if metric == "cosine" else self.vectors
        self.longest = _longest(self.vectors)
        self.distance = np.full((len(self.ids), k), np.nan)
        self.number = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.order = np.argsort(self.ids)

    def meet(self, piece: _Piece, metric: str, exclude: bool) -> None:
        barred = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if exclude:
            at = np.minimum(np.searchsorted(self.ids, piece.own, sorter=self.order), len(self.ids) - 1)
            same = np.flatnonzero(piece.owned & (self.ids[self.order[at]] == piece.own))
            barred = self.order[at[same]], same
        found = []
        for first in range(0, len(self.ids), _SCREEN_ROWS):
            part = slice(first, first + _SCREEN_ROWS)
            here = (barred[0] >= first) & (barred[0] < first + _SCREEN_ROWS)
            row, col = self._near(part, piece, metric, (barred[0][here] - first, barred[1][here]))
            found.append((row + first, col))
            # Close pairs are measured together, but never more than fit.
            if sum(len(r) for r, _ in found) >= _TILE_CELLS // 64 or first + _SCREEN_ROWS >= len(self.ids):
                self._measure(*(np.concatenate(x) for x in zip(*found)), piece, metric)
                found = []

    def _measure(self, row: np.ndarray, col: np.ndarray, piece: _Piece, metric: str) -> None:
        for at in range(0, len(row), _TILE_CELLS // 64):
            some = slice(at, at + _TILE_CELLS // 64)
            q, c = self.vectors[row[some]].astype(np.float64), piece.vectors[col[some]].astype(np.float64)
            self._merge(row[some], _exact(q, c, metric), piece.numbers[col[some]])

    def _near(self, part: slice, piece: _Piece, metric: str, barred: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that may be among the best ``k``."""
        k = self.distance.shape[1]
        limit, compared = self.distance[part, -1], self.compared[part]
        if metric != "l2" and not np.isnan(limit).any():
            # Written into the same two blocks of memory every time; products are compared as they are.
            shape = len(compared), len(piece.compared)
            dots, keep = piece.room(shape)
            np.matmul(compared, piece.compared.T, out=dots)
            reach = 1.0 if metric == "cosine" else max(1.0, self.longest * piece.longest)
            slack = 8.0 * (compared.shape[1] + 4) * np.finfo(np.float32).eps * reach
            floor = np.nextafter((1.0 - (limit + slack)).astype(np.float32), np.float32(-np.inf))
            np.less(dots, floor[:, None], out=keep)
            # A product that is not a number stays in and is reported later.
            np.logical_not(keep, out=keep)
        else:
            near, slack = _approximate(compared, piece.compared, metric)
            near[barred] = np.inf
            if np.isnan(limit).any() and near.shape[1] > k:
                # The k-th approximate distance bounds the true one up to rounding.
                here = np.partition(near, k - 1, axis=1)[:, k - 1].astype(np.float64)
                limit = np.where(np.isnan(limit), here, limit)
            # Rounded up; a distance that is not a number stays in and is reported later.
            limit = np.nextafter((limit + slack).astype(np.float32), np.float32(np.inf))
            keep = ~(near > limit[:, None])
        keep[barred] = False
        return np.divmod(_places(keep), keep.shape[1])

    def _merge(self, row: np.ndarray, distance: np.ndarray, number: np.ndarray) -> None:
        k = self.distance.shape[1]
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, k), row])
        distance = np.concatenate([self.distance[touched].ravel(), distance])
        number = np.concatenate([self.number[touched].ravel(), number])
        order = np.lexsort((number, distance, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.distance[touched] = distance[best].reshape(-1, k)
        self.number[touched] = number[best].reshape(-1, k)

    def hits(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.number != np.iinfo(np.int64).max)
        columns = [self.ids[row], self.number[row, place], self.distance[row, place]]
        return pa.record_batch([pa.array(c) for c in columns], ["question_id", "number", "distance"])


def _sent_once(pairs: DataFrame) -> DataFrame:
    """Pairs of pieces with the bytes of a piece only where a task meets it first: those of chunks
    beside its first piece of questions, those of questions beside its first piece of chunks."""

    def first(name: str) -> Column:
        return F.col(name).bitwiseAND((1 << 33) - 1) == 0

    chunks = [F.when(first("place"), F.col(c)).alias(c) for c in ("numbers", "vectors", "own", "owned")]
    return pairs.select("piece", "place", *chunks, *[F.when(first("piece"), F.col(c)).alias(c) for c in ("ids", "asked")])


def _meet(k: int, metric: str, exclude: bool):
    """Rows of a piece of chunks and a piece of questions; all questions of a task come with every
    one of its pieces of chunks, one piece of chunks after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Asked] = {}
        last, piece = None, None
        for batch in batches:
            pairs = zip(batch["piece"].to_pylist(), batch["place"].to_pylist())
            for at, (now, place) in enumerate(pairs):
                if now != last:
                    row = {c: batch[c][at].as_py() for c in ("numbers", "vectors", "own", "owned")}
                    last, piece = now, _Piece(row, k, metric, exclude)
                if place not in asked:
                    asked[place] = _Asked(batch["ids"][at].as_py(), batch["asked"][at].as_py(), k, metric)
                asked[place].meet(piece, metric, exclude)
        for one in asked.values():
            yield one.hits()

    return run


def _asked_once(questions: DataFrame) -> DataFrame:
    return questions.groupBy("embedding").agg(F.min("question_id").alias("question_id"))


def _by_grid(questions: DataFrame, corpus: DataFrame, total: int, width: int, k: int, metric: str, exclude: bool, cfg: EngineConfig) -> DataFrame:
    """The best ``k`` hits of any number of questions, with ids that occur once."""
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # Numbers follow the tie-breakers, so that (distance, number) is the full order.
    numbered = materialize(corpus.sort(*KEYS).withColumn("number", F.monotonically_increasing_id()), "knn-vectors")
    if exclude:
        asked = questions.select("question_id", "embedding")
    else:
        questions = materialize(questions.select("question_id", "embedding"), "knn-questions")
        asked = _asked_once(questions)
    each = max(1, width) * 4
    rows = max(1, min(_PIECE_BYTES // each, _PIECE_ROWS))
    wanted = ["number", "embedding"] + (["question_id"] if exclude else [])
    chunks = numbered.select(*wanted).mapInArrow(
        _pack_chunks(exclude, rows), "numbers binary, vectors binary, own binary, owned binary"
    )
    held = max(1, min(rows, cfg.broadcast_questions, cfg.broadcast_bytes // each))
    parts = max(1, min(2 * cores, total // (4 * held)))
    asked = asked.select("question_id", "embedding").repartition(parts).mapInArrow(_pack_questions(held), "ids binary, asked binary")
    chunks, asked = materialize(chunks, "knn-chunk-pieces"), materialize(asked, "knn-question-pieces")
    # A task holds its questions with their vectors and hits, and streams its chunks.
    shares = max(1, -(-total * (2 * each + 16 * k) // _TASK_BYTES))
    chunks = chunks.repartition(2 * cores).withColumn("piece", F.monotonically_increasing_id())
    asked = asked.repartition(shares).withColumn("place", F.monotonically_increasing_id())
    pairs = _sent_once(chunks.crossJoin(asked.hint("shuffle_replicate_nl")))
    found = pairs.mapInArrow(_meet(k, metric, exclude), "question_id long, number long, distance double")
    hits = materialize(_nearest(found, k, ["distance", "number"]), "knn-hits")
    hits = hits.join(numbered.select("number", *KEYS), "number").drop("number")
    if not exclude:
        same = questions.withColumnRenamed("question_id", "id").join(_asked_once(questions), "embedding").select("id", "question_id")
        hits = hits.join(same, "question_id").drop("question_id").withColumnRenamed("id", "question_id")
    return hits.select("question_id", "chunk_id", "document_fingerprint", "sequence", "distance")


def knn(
    questions: DataFrame,
    chunks: DataFrame,
    k: int,
    metric: str = "cosine",
    cfg: EngineConfig | None = None,
    exclude_self: bool = False,
    check: bool = True,
) -> DataFrame:
    """The ``min(k, chunks)`` nearest chunks per question.

    A distance that is no finite number fails the job, or with ``check`` off is returned for
    ``split_finite``; vectors of another length than the chunks' must have been split off by
    ``validate_vectors``.

    ``questions`` has ``question_id`` and ``embedding``; ``chunks`` has the key columns and
    ``embedding``, of which nothing else is read. With ``exclude_self``, a chunk row naming
    a question in its own ``question_id`` is no candidate for it. Rows that repeat a question id
    are one question; of different vectors the least is taken, element by element.
    """
    cfg = cfg or EngineConfig()
    corpus = _corpus(chunks)
    exclude = exclude_self and "question_id" in chunks.columns
    asked = questions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("question_id").alias("ids"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")
    ).first()
    if asked["rows"] > asked["ids"]:
        questions = questions.groupBy("question_id").agg(F.min("embedding").alias("embedding"))
    total, size = asked["rows"], asked["rows"] * asked["width"] * 4
    if total == 0:
        hits = questions.sparkSession.createDataFrame([], _HITS)
    elif total <= cfg.broadcast_questions and size <= cfg.broadcast_bytes:
        hits = _by_broadcast(questions, corpus, k, metric, exclude)[0]
    else:
        hits = _by_grid(questions, corpus, asked["ids"], asked["width"], k, metric, exclude, cfg)
    cut = _nearest(hits, k)
    return _require_finite(cut) if check else cut


def rank_candidates(hits: DataFrame) -> DataFrame:
    """Rank from 1 by distance, then sequence."""
    order = Window.partitionBy("question_id").orderBy("distance", "sequence", "document_fingerprint", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).withColumn(
        "source_id", F.concat("document_fingerprint", F.lit(":"), "chunk_id")
    )


def accept(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates within the threshold, which is inclusive."""
    return candidates.filter(F.col("distance") <= threshold)
