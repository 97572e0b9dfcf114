"""Finding entities by name, by vector and by question."""

from __future__ import annotations

from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from latticework.cluster import ship, stored
from latticework.functions.text import cosine, query_spelling, token_estimate, words

from .graph import first_by

#: Intents in order: the first list with a phrase in the question wins.
INTENTS = (
    ("impact", ("affected by", "callers of", "depends on", "impact", "what breaks", "who calls")),
    ("chain", ("chain", "flow from", "how does", "path from", "reach")),
    ("similarity", ("find", "like", "related", "search", "similar")),
    ("dependency", ("dependencies", "imports", "module graph", "what imports")),
    ("definition", ("define", "definition", "show me", "signature of", "what is")),
)
DEFAULT_INTENT = "exploration"
PRIMITIVES = {"impact": "callers", "chain": "path", "similarity": "search_similar", "dependency": "imports", "definition": "lookup", "exploration": "search"}


def name_score(name: Column, query: str, module: Column | None = None) -> Column:
    """100 for the name itself, 50 for its beginning, 25 for a part of it; 90, 40 and 20 for modules.  Case doesn't count."""
    low, q = F.lower(name), F.lit(query.lower())
    exact, first, part = (F.lit(x) if module is None else F.when(module, y).otherwise(x) for x, y in ((100, 90), (50, 40), (25, 20)))
    return F.when(low == q, exact).when(F.startswith(low, q), first).when(F.contains(low, q), part)


def search_names(entities: DataFrame, query: str, top_k: int = 10, kind: str | None = None) -> DataFrame:
    """entities with a score, best first, ties by id.  An empty query matches everything; kind filters before the cut."""
    rows = entities if kind is None else entities.where(F.col("kind") == kind)
    scored = rows.withColumn("score", name_score(F.col("name"), query, F.col("kind") == "module"))
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(top_k)


def search_vectors(vectors: DataFrame, query: list[float], top_k: int = 10, key: str = "id", column: str = "embedding") -> DataFrame:
    """vectors with their cosine to the query, nearest first: one pass, and a top-k that sends k rows a task."""
    array = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", cosine(F.col(column), array)).orderBy(F.desc("similarity"), key).limit(top_k)


#: Queries of a pass of nearest(), and rows that meet them at once.
QUERIES, ROWS = 1024, 1024
#: Digits by which similarities are ranked: equal vectors tie wherever they stand, and the lower key wins.
DIGITS = 9


def nearest(queries: DataFrame, vectors: DataFrame, top_k: int = 10, key: str = "id", column: str = "embedding") -> DataFrame:
    """(query, key, similarity): the top_k vectors of each of queries (key, column), by cosine; every query meets every vector.

    Queries go in blocks: each is one pass over vectors by products of
    matrices, which sends top_k rows a query and task.  A block is all that the
    driver and a broadcast hold; its result is a stored table.  Vectors of
    another length, without length or missing have similarity 0.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    id_type = vectors.schema[key].dataType.simpleString()
    schema = f"query {id_type}, {key} {id_type}, similarity double"
    id_arrow = to_arrow_type(vectors.schema[key].dataType)

    def unit(rows: list) -> list:
        out = []
        for v in rows:
            x = np.zeros(0) if v is None or any(e is None for e in v) else np.asarray(v, float)
            n = np.linalg.norm(x)
            out.append(x / n if np.isfinite(n) and n > 0 else np.zeros(0))
        return out

    def by_length(rows: list) -> dict:
        size = np.array([len(x) for x in rows])
        return {int(d): (at, np.stack([rows[i] for i in at])) for d in np.unique(size[size > 0]) for at in [np.flatnonzero(size == d)]}

    def one_pass(block):
        asked = spark.sparkContext.broadcast(([r[0] for r in block], by_length(unit([r[1] for r in block]))))

        def run(batches):
            ids, known = asked.value
            best, score = None, None
            for b in batches:
                for i in range(0, b.num_rows, ROWS):
                    own = b.slice(i, ROWS)
                    name = np.asarray(own.column(0).to_pylist())
                    near = np.zeros((len(ids), len(name)))
                    for d, (at, x) in by_length(unit(own.column(1).to_pylist())).items():
                        if d in known:
                            near[np.ix_(known[d][0], at)] = known[d][1] @ x.T
                    near, name = np.round(near, DIGITS), np.broadcast_to(name, near.shape)
                    if best is not None:
                        near, name = np.concatenate([score, near], axis=1), np.concatenate([best, name], axis=1)
                    order = np.lexsort((name, -near), axis=1)[:, :top_k]
                    score, best = np.take_along_axis(near, order, 1), np.take_along_axis(name, order, 1)
            if best is not None:
                many = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([q for q in ids for _ in range(many)], id_arrow), pa.array(best.ravel().tolist(), id_arrow), pa.array(score.ravel())], ["query", key, "similarity"])

        found = vectors.where(F.col(key).isNotNull()).select(key, column).mapInArrow(run, schema)
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
        out = stored(found.withColumn("_lw_at", F.row_number().over(w)).where(F.col("_lw_at") <= top_k).drop("_lw_at"), "nearest")
        asked.destroy()
        return out

    rows = queries.where(F.col(key).isNotNull()).select(key, column).toLocalIterator()
    out = [one_pass(block) for block in batched(rows, QUERIES)]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def intent(question: Column) -> Column:
    low = F.lower(question)
    out = None
    for name, phrases in INTENTS:
        hit = F.regexp(low, F.lit("|".join(phrases)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_INTENT)


def plan(questions: DataFrame) -> DataFrame:
    """questions (question) with intent, primitive and the names in them."""
    table = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    out = questions.withColumn("intent", intent(F.col("question")))
    return out.withColumn("primitive", table[F.col("intent")]).withColumn("names", words(query_spelling(F.col("question"))))


def within_budget(rows: DataFrame, budget: int, order: str, text: str = "text", group: str | None = None) -> DataFrame:
    """The rows, in order, whose estimated tokens together stay within the budget; with group, within each group.

    A row costs a token at least, so without groups no row beyond the first ``budget`` can be within it.
    """
    if group is None:
        rows = rows.orderBy(order).limit(budget)
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cost = rows.withColumn("tokens", token_estimate(F.col(text)))
    return cost.withColumn("total", F.sum("tokens").over(w)).where(F.col("total") <= budget)


def resolve_names(names: DataFrame, entities: DataFrame, per_name: int = 3) -> DataFrame:
    """(query, id, score) for each (query): the entity of that id, else the best by name."""
    exact = names.join(entities.select("id"), names["query"] == entities["id"]).select("query", "id", F.lit(1000).alias("score"))
    rest = names.join(exact.select("query"), "query", "left_anti")
    # equal names meet by key; only those without an equal are compared as parts
    low = entities.select("id", F.lower("name").alias("low"), (F.col("kind") == "module").alias("m"))
    q = rest.select("query", F.lower("query").alias("q"))
    same = q.join(low, F.col("q") == F.col("low")).select("query", "id", F.when(F.col("m"), 90).otherwise(100).alias("score"))
    part = q.join(low, F.contains("low", F.col("q")) & (F.col("q") != F.col("low"))).select("query", "id", F.when(F.startswith("low", F.col("q")), F.when(F.col("m"), 40).otherwise(50)).otherwise(F.when(F.col("m"), 20).otherwise(25)).alias("score"))
    best = same.unionByName(part).withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return exact.unionByName(best.where(F.col("at") <= per_name).drop("at"))


def framework_references(claims: DataFrame, references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, id, resolver, confidence): what frameworks make of names that imports left open.

    claims: (resolver, pattern, folder, sure, otherwise); a resolver claims a name that
    matches its pattern, and is surer of candidates in its folder.
    """
    claimed = references.select("name").distinct().join(claims, F.regexp("name", F.col("pattern")))  # a handful of rules
    found = claimed.join(candidates.select("name", "id", "path"), "name")
    found = found.withColumn("confidence", F.when(F.contains("path", F.col("folder")), F.col("sure")).otherwise(F.col("otherwise")))
    return first_by(found, ["name", "id"], F.desc("confidence"), "resolver").select("name", "id", "resolver", "confidence")


def to_embed(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entities whose content has no vector yet: one row a content, however many entities share it."""
    new = entities.join(vectors.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    return first_by(new, ["content_hash"], "id")


def embed(entities: DataFrame, vectors: DataFrame, model, dim: int) -> DataFrame:
    """vectors brought up to date: model takes a list of texts and gives vectors; equal contents are computed once."""
    import pyarrow as pa

    from latticework.cluster import ship

    ship(entities.sparkSession)
    todo = to_embed(entities, vectors)
    schema = pa.schema([("content_hash", pa.string()), ("embedding", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            found = [[float(x) for x in v] for v in model(b.column(1).to_pylist())]
            if any(len(v) != dim for v in found):
                raise ValueError(f"the model gave vectors of another length than {dim}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    fresh = todo.select("content_hash", "source").mapInArrow(run, "content_hash string, embedding array<double>")
    known = vectors.select("content_hash", F.col("embedding").cast("array<double>").alias("embedding"))
    every = first_by(known.unionByName(fresh), ["content_hash"], F.size("embedding"))
    return entities.select("id", "content_hash").join(every, "content_hash").select("id", "content_hash", "embedding")
