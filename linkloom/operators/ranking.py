"""Vectors, ranking features, the linear ranker and its training rows.

Vectors are looked up by (language, key); words on a stop list and unknown keys have none. Means leave
missing vectors out, and a mean of nothing is the zero vector. Sums are made in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.functions import vectors as V
from linkloom.operators.numbering import bounded_sample, numbered

# Languages that use another language's vectors.
VECTOR_LANGUAGE = {"en": "es", "am": "es"}
# Names of the base features, in order.
BASE_FEATURES = (
    "TITLEPROB", "SURFACEPROB", "NE_TITLE_COS", "NE_TITLE_COS_L", "NE_MINMAX_MAX", "NE_MINMAX_MIN", "NE_MINMAX_L_MAX", "NE_MINMAX_L_MIN",
    "PRETITLE_COS", "PRETITLE_COS_L", "PRE_MINMAX_MAX", "PRE_MINMAX_MIN", "PRE_MINMAX_L_MAX", "PRE_MINMAX_L_MIN",
    "W_CON30", "W_CON30_L", "W_CON100", "W_CON100_L", "W_CON200", "W_CON200_L",
)
HALF_WINDOWS = {"W_CON30": 5, "W_CON100": 10, "W_CON200": 25}


def features_of(lang_is_english: bool, ner_mode: bool = False) -> tuple[str, ...]:
    """Names of the base features: the foreign-title ones only for other languages, entity ones only outside tagging."""
    foreign = lambda f: f.endswith("_L") or "_L_" in f
    entity = lambda f: f.startswith(("NE_", "PRE"))
    return tuple(f for f in BASE_FEATURES if not (lang_is_english and foreign(f)) and not (ner_mode and entity(f)))


def feature_ids(names: Sequence[str], known: dict[str, int] | None = None, is_open: bool = True) -> dict[str, int]:
    """Feature -> id from 1 on; while the lexicon is open new names get the next ids, later they are left out."""
    ids = dict(known or {})
    for name in names if is_open else ():
        ids.setdefault(name, len(ids) + 1)
    return ids


def word_vectors(words: DataFrame, vectors: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """Rows with ``vec`` of their (lang, word); null for stop words and unknown ones."""
    known = vectors.select(F.col("lang"), F.col("key").alias("word"), "vec")
    if stop_words is not None:
        known = known.join(stop_words.select("lang", "word").distinct(), ["lang", "word"], "left_anti")
    return words.join(known, ["lang", "word"], "left")


def mean_vector(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, mean): mean of ``vec``, weighted if asked; zero vector if the weights sum to nothing. Weights aren't negative.

    Vectors stay whole and are summed on the map side first. A row without weight counts as a zero vector of next
    to no weight, so that a key of such rows only has the zero vector as its mean.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = V.doubles(F.col("vec"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    nothing = ~(F.coalesce(w, F.lit(0.0)) > 0)
    each = rows.where("vec is not null and size(vec) > 0").select(
        *keys, array_to_vector(F.when(nothing, F.transform(vec, lambda x: x * 0.0)).otherwise(vec)).alias("_v"), F.when(nothing, F.lit(1e-200)).otherwise(w).alias("_w")
    )
    return each.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("mean"))


def extreme_cosines(pairs: DataFrame, keys: list[str], a: str = "title_vec", b: str = "other_vec") -> DataFrame:
    """(keys, cos_max, cos_min) over the other vectors of a key; 0 without any."""
    scored = pairs.select(*keys, V.cosine(F.col(a), F.col(b)).alias("_c"))
    return scored.groupBy(*keys).agg(F.coalesce(F.max("_c"), F.lit(0.0)).alias("cos_max"), F.coalesce(F.min("_c"), F.lit(0.0)).alias("cos_min"))


def extreme_cosines_within(rows: DataFrame, group: str, block: int = 256) -> DataFrame:
    """(group, id, cos_max, cos_min): greatest and least cosine of each vector to the others of its group; 0 without others.

    ``rows`` has (group, id, vec), ids distinct in a group. A group is cut into blocks of about ``block``
    vectors and pairs of blocks are multiplied as matrices, so that no row is made for a pair of vectors.
    """
    valid = rows.where(F.col("vec").isNotNull()).select(group, "id", "vec")
    sizes = valid.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    parted = valid.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    blocks = parted.groupBy(group, "part").agg(F.collect_list(F.struct("id", "vec")).alias("own"))
    pairs = blocks.join(blocks.select(group, F.col("part").alias("o_part"), F.col("own").alias("other")), group)

    def multiply(batches):
        for batch in batches:
            for g, own, other in zip(batch[group], batch["own"], batch["other"], strict=True):
                ids, o_ids = np.array([r["id"] for r in own]), np.array([r["id"] for r in other])
                a, b = (np.array([r["vec"] for r in side], dtype=float) for side in (own, other))
                norms = [np.linalg.norm(m, axis=1) for m in (a, b)]
                a, b = (m / np.where(n > 0, n, 1)[:, None] for m, n in zip((a, b), norms, strict=True))
                cos = a @ b.T
                same = ids[:, None] == o_ids[None, :]
                most, least = np.where(same, -np.inf, cos).max(axis=1), np.where(same, np.inf, cos).min(axis=1)
                seen = ~same.all(axis=1)
                yield pd.DataFrame({group: g, "id": ids[seen], "cos_max": most[seen], "cos_min": least[seen]})

    kinds = dict(valid.dtypes)
    partial = pairs.select(group, "own", "other").mapInPandas(multiply, f"{group} {kinds[group]}, id {kinds['id']}, cos_max double, cos_min double")
    found = partial.groupBy(group, "id").agg(F.max("cos_max").alias("cos_max"), F.min("cos_min").alias("cos_min"))
    return rows.select(group, "id").join(found, [group, "id"], "left").fillna(0.0, ["cos_max", "cos_min"])


def with_products(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with COMBO_a_b for each pair of features."""
    return rows.withColumns(dict(V.feature_products(names)))


def score_candidates(rows: DataFrame, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Rows with ``score``, the linear model over base features and their products."""
    columns = [F.col(n) for n in names] + [c for _, c in V.feature_products(names)]
    return rows.withColumn("score", V.linear_score(columns, weights))


def best_candidate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title, score, confidence): the best candidate; earlier rank wins ties; confidence from the best two scores."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "rank")
    second = F.lead("score").over(order)
    ranked = scored.withColumns({"_n": F.row_number().over(order), "confidence": V.top_two_confidence(F.col("score"), second)})
    return ranked.where("_n = 1").select(*keys, "title", "score", "confidence")


def weight_matrix(names: Sequence[str], order: Sequence[str], weights: Sequence[float]) -> np.ndarray:
    """Weights of features and of their products as a matrix in another order of features: x'Wx with a last feature of 1."""
    at = {n: order.index(n) for n in names}
    w = np.zeros((len(order) + 1, len(order) + 1))
    pairs = [(n, None) for n in names] + [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), value in zip(pairs, weights):
        w[at[a], at[b] if b is not None else len(order)] += value
    return w


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, which of them aren't null) of an array column whose arrays are of one length; a null is a row of zeros."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = np.zeros((len(column), len(flat) // has.sum() if has.any() else 0))
    if has.any():
        rows[has] = flat.reshape(int(has.sum()), -1)
    return rows, has


class _Walk:
    """The titles chosen so far in a document: sum and number of their vectors, and the different ones, unit length."""

    def __init__(self, sequential: tuple[str, ...], w: np.ndarray) -> None:
        self.sequential, self.w, self.doc = sequential, w, None

    def begin(self, doc) -> None:
        self.doc, self.total, self.n, self.seen, self.chosen = doc, None, 0, set(), None

    def columns(self, own: np.ndarray, foreign: np.ndarray) -> list[np.ndarray]:
        """Sequential features of a mention's candidates."""
        out, known = [], {}
        mean = _unit(self.total) if self.n else None
        for name in self.sequential:
            side = foreign if "_L" in name else own
            if not self.n or side.shape[1] != self.total.shape[0]:
                out.append(np.zeros(len(own)))
            elif name.startswith("PRETITLE"):
                out.append(side @ mean)
            else:
                # a title chosen twice changes neither the greatest nor the least
                key = "_L" in name
                if key not in known:
                    known[key] = side @ self.chosen[: len(self.seen)].T, (side != 0).any(axis=1)
                cos, any_vec = known[key]
                out.append(np.where(any_vec, cos.max(axis=1) if name.endswith("MAX") else cos.min(axis=1), 0.0))
        return out

    def take(self, title: str, vec: np.ndarray, unit: np.ndarray) -> None:
        self.total, self.n = vec.copy() if self.total is None else self.total + vec, self.n + 1
        if title not in self.seen:
            if self.chosen is None:
                self.chosen = np.zeros((8, len(vec)))
            elif len(self.seen) == len(self.chosen):
                self.chosen = np.concatenate([self.chosen, np.zeros_like(self.chosen)])
            self.chosen[len(self.seen)] = unit
            self.seen.add(title)

    def mentions(self, batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        """The best candidate of each mention; ``bounds`` are the mentions' first rows and the end."""
        static = _matrix(batch.column("features"))[0]
        (own, has), (foreign, _) = _matrix(batch.column("vec")), _matrix(batch.column("l_vec"))
        unit, unit_l = _unit(own), _unit(foreign)
        docs, titles, ranks = batch.column("doc_id").to_pylist(), batch.column("title").to_pylist(), batch.column("rank").to_numpy(zero_copy_only=False)
        best, scores, shares = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if docs[a] != self.doc:
                self.begin(docs[a])
            x = np.column_stack([static[a:b], *self.columns(unit[a:b], unit_l[a:b]), np.ones(b - a)])
            score = ((x @ self.w) * x).sum(axis=1)
            order = np.lexsort((ranks[a:b], -score))
            top = a + int(order[0])
            best.append(top)
            scores.append(float(score[order[0]]))
            shares.append(1.0 if b - a == 1 else float(1.0 / (1.0 + np.exp(min(700.0, score[order[1]] - score[order[0]])))))
            if has[top]:
                self.take(titles[top], own[top], unit[top])
        chosen = batch.take(pa.array(best, pa.int64()))
        columns = [chosen.column(c) for c in ("doc_id", "mention_id", "title")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=["doc_id", "mention_id", "title", "score", "confidence"])


def rank_sequentially(candidates: DataFrame, sequential: Sequence[str], w: np.ndarray) -> DataFrame:
    """Document by document, mention by mention: the titles chosen before feed the next mention's features.

    ``candidates`` has doc_id, mention_id, start, rank, title, features (array), vec and l_vec. ``w`` is the matrix of the
    model over the features, the sequential ones and 1. Rows are walked in order, so that a task holds the candidates of a
    batch and the different vectors chosen in its document, never a whole document.
    """
    kinds, sequential = dict(candidates.dtypes), tuple(sequential)
    narrow = candidates.where("doc_id is not null and mention_id is not null").select("doc_id", "mention_id", "start", "rank", "title", "features", "vec", "l_vec")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rest = _Walk(sequential, w), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            ids = batch.column("mention_id").to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            # the last mention may go on in the next batch
            if len(bounds) > 1:
                yield state.mentions(batch.slice(0, int(bounds[-1])), bounds)
            rest = batch.slice(int(bounds[-1]))
        if rest is not None:
            yield state.mentions(rest, np.array([0, rest.num_rows]))

    schema = f"doc_id {kinds['doc_id']}, mention_id {kinds['mention_id']}, title string, score double, confidence double"
    return narrow.repartition("doc_id").sortWithinPartitions("doc_id", "start", "mention_id", "rank").mapInArrow(walk, schema)


def rank_documents(candidates: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``rank_sequentially`` with three sequential features: cosine to the mean of the vectors chosen before, greatest and least cosine to them.

    ``candidates`` has doc_id, mention_id, start, rank, title, features (array of the static ones) and vec. ``weights`` are
    those of the static features followed by these three; features beyond the weights count nothing.
    """
    first = candidates.select(F.size("features").alias("n")).first()
    n = first["n"] if first else 0
    sequential = ("PRETITLE_COS", "PRE_MINMAX_MAX", "PRE_MINMAX_MIN")
    names = [*[f"_{i}" for i in range(n)], *sequential]
    rows = candidates.withColumn("l_vec", F.lit(None).cast("array<double>"))
    return rank_sequentially(rows, sequential, weight_matrix(names, names, list(weights)[: len(names)]))


def select_training(mentions: DataFrame, candidates: DataFrame, types: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(mention_id, lang, kind): hard mentions and a sample of easy ones, ``ratio`` to each hard one, by hash order.

    Easy means that the first candidate is the gold title; mentions without the gold title among their
    candidates aren't trained on. Of a document with entities of the main types only those count.
    """
    main = F.arrays_overlap("types", F.array(*[F.lit(t) for t in ("people.person", "organization.organization", "location.location")]))
    typed = mentions.join(types.select("mid", "types"), "mid", "left").withColumn("_main", F.coalesce(main, F.lit(False)))
    any_main = F.max("_main").over(Window.partitionBy("doc_id"))
    kept = typed.withColumn("_any", any_main).where("_main or not _any")
    keyed = kept.select("mention_id", "lang", X.normal_surface(F.col("surface")).alias("surface"), X.normal_title(F.col("gold_wiki_title")).alias("gold"))
    hit = keyed.join(candidates.select("lang", "surface", "rank", F.col("title").alias("gold")), ["lang", "surface", "gold"])
    labelled = hit.withColumn("kind", F.when(F.col("rank") == 1, F.lit("easy")).otherwise(F.lit("hard"))).select("mention_id", "lang", "kind")
    hard = labelled.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "hard", 1).otherwise(0)).alias("n_hard"))
    # numbered over all languages at once, so that no task has to sort a language
    hashed = labelled.withColumn("_h", F.md5(F.col("mention_id").cast("string")))
    placed = numbered(hashed, ["lang", "kind", "_h", "mention_id"], "_n")
    first = placed.groupBy("lang", "kind").agg(F.min("_n").alias("_first"))  # a row or two for each language
    shifted = placed.join(F.broadcast(first), ["lang", "kind"]).withColumn("_n", F.col("_n") - F.col("_first") + 1).join(F.broadcast(hard), "lang")
    return shifted.where((F.col("kind") == "hard") | (F.col("_n") <= F.col("n_hard") * ratio)).select("mention_id", "lang", "kind")


def svm_rows(candidates: DataFrame, features: Sequence[str], key: str = "mention_id") -> DataFrame:
    """(qid, rank, line): training lines ``label qid:n index:value ...``; label 2 for the gold title, else 1; zero features are left out."""
    label = F.when(F.lower("title") == F.lower("gold"), F.lit("2")).otherwise(F.lit("1"))
    shown = F.array(*[F.when(F.col(f) != 0, F.format_string(f"{i}:%.7f", F.col(f))) for i, f in enumerate(features, 1)])
    return candidates.select(
        F.col(key).alias("qid"), "rank", F.concat_ws(" ", label, F.concat(F.lit("qid:"), F.col(key).cast("string")), F.filter(shown, lambda x: x.isNotNull())).alias("line")
    )


def train_ranker(candidates: DataFrame, features: Sequence[str], key: str = "mention_id", c: float = 0.01, max_pairs: int = 200_000):
    """Weights of a linear ranker from differences of the gold candidate and the others of a mention (MLlib's LinearSVC).

    At most ``max_pairs`` pairs, chosen by hash, are learned from; without any pair all weights are 0.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = candidates.select(key, (F.lower("title") == F.lower("gold")).alias("is_gold"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "title")
    gold = rows.where("is_gold").select(key, F.col("x").alias("g"))
    pairs = bounded_sample(rows.where("not is_gold").join(gold, key), [key, "title"], max_pairs)
    sign = F.when(F.pmod(F.xxhash64("title", key), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    signed = pairs.withColumn("s", sign).select(
        F.when(F.col("s") > 0, 1.0).otherwise(0.0).alias("label"),
        array_to_vector(F.transform(F.zip_with("g", "x", lambda a, b: a - b), lambda d: d * F.col("s"))).alias("features"),
    )
    if signed.isEmpty():
        return [0.0] * len(features)
    model = LinearSVC(regParam=c, fitIntercept=False, standardization=False, maxIter=50).fit(signed)
    return [float(v) for v in model.coefficients]


def context_vectors(weighted: DataFrame, vectors: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, mean): the TF-IDF-weighted mean of a context's word vectors; words without vector are skipped."""
    return mean_vector(word_vectors(weighted, vectors), [key], "weight")


def mention_vectors(mentions: DataFrame, vectors: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, mean): the mean of the word vectors of a mention's surface."""
    words = mentions.select(key, "lang", F.explode(F.filter(F.split(F.lower("surface"), r"\s+|·"), lambda t: t != "")).alias("word"))
    return mean_vector(word_vectors(words, vectors), [key])


def surface_features(rows: DataFrame) -> DataFrame:
    """Optional features of a surface against a title: equal initials, one beginning with the other, equal number of words, place in the list."""
    typed = X.title_as_surface(F.col("title"))
    return rows.withColumns(
        {
            "SAME_INITIALS": (X.initials(F.col("surface")) == X.initials(typed)).cast("double"),
            "PREFIX": (typed.startswith(F.lower("surface")) | F.lower("surface").startswith(typed)).cast("double"),
            "SAME_LENGTH": (F.size(X.tokens_of(F.col("surface"))) == F.size(X.tokens_of(typed))).cast("double"),
            "ISTOP": (F.col("rank") == 1).cast("double"),
        }
    )


def source_features(rows: DataFrame, sources: Sequence[str], column: str = "src") -> DataFrame:
    """Optional features SRC:<source>, 1 for the source that a candidate is from, and PRESCORE, the score it came with."""
    made = {f"SRC:{s}": (F.coalesce(F.col(column), F.lit("")) == s).cast("double") for s in sources}
    return rows.withColumns(made | ({"PRESCORE": F.coalesce(F.col("score"), F.lit(0.0))} if "score" in rows.columns else {}))


def save_weights(spark: SparkSession, names: Sequence[str], weights: Sequence[float], path: str) -> None:
    """Feature names and weights of a ranker as one JSON table."""
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip(names, weights, strict=True))]
    spark.createDataFrame(rows, "place int, feature string, weight double").coalesce(1).write.mode("errorifexists").json(path)


def load_weights(spark: SparkSession, path: str) -> tuple[list[str], list[float]]:
    """What ``save_weights`` wrote."""
    rows = spark.read.schema("place int, feature string, weight double").json(path).orderBy("place").collect()
    return [r["feature"] for r in rows], [r["weight"] for r in rows]


def read_model(lines: Sequence[str]) -> list[float]:
    """Weights of a ranking model text: the numbers behind the line ``w``."""
    at = next(i for i, line in enumerate(lines) if line.strip() == "w")
    return [float(line) for line in lines[at + 1 :] if line.strip()]
