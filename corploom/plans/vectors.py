"""Array and matrix queries over ``embeddings``, and closed-form tables (schedules, rotary angles, parameter counts).

Results are rounded to six digits on both sides; sums run over DOUBLE.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import table
from ..sources.buildlogs import to_ns
from .registry import query
from .tables import sql_query

_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("a"))


def _rounded(column, name):
    return F.transform(column, lambda x: F.round(x, 6)).alias(name)


def _elementwise(name: str, fn, duck: str) -> None:
    """One function of x over every element; reported as the vector's sum and first element, rounded."""
    query(name, f"SELECT vec_id, round(list_sum(list_transform(a, lambda x: {duck})), 5) AS total, round(list_transform(a, lambda x: {duck})[1], 6) AS head FROM {_E}")(
        lambda spark, d: _vectors(spark, d).select("vec_id", F.transform("a", fn).alias("y")).select("vec_id", F.round(A.total(F.col("y")), 5).alias("total"), F.round(F.get("y", F.lit(0)), 6).alias("head"))
    )


_elementwise("scale", lambda x: x * 2.5, "x * 2.5")
_elementwise("add_scalar", lambda x: x + 1.25, "x + 1.25")
_elementwise("neg", lambda x: -x, "-x")
_elementwise("exp", F.exp, "exp(x)")
_elementwise("ln", lambda x: F.log(F.abs(x) + 1), "ln(abs(x) + 1)")
_elementwise("sqrt", lambda x: F.sqrt(F.abs(x)), "sqrt(abs(x))")
_elementwise("powf", lambda x: F.pow(F.abs(x), F.lit(1.5)), "pow(abs(x), 1.5)")
_elementwise("tanh", F.tanh, "tanh(x)")
_elementwise("sigmoid", A.sigmoid, "1 / (1 + exp(-x))")
_elementwise("relu", A.relu, "greatest(x, 0.0)")
_elementwise("silu", A.silu, "x / (1 + exp(-x))")
_elementwise("gelu", A.gelu, "0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))")

for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    # the second operand is the mean vector, broadcast over rows: one row, so its size is fixed
    query(_name, f"WITH m AS (SELECT list(v ORDER BY i) AS b FROM (SELECT i, avg(a[i]) + 2 AS v FROM {_E} t, unnest(range(1, len(a) + 1)) u(i) GROUP BY i)) SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] {_op} p[2])), 4) AS total FROM {_E} t, m")(
        lambda spark, d, op=_op: _vectors(spark, d)
        .crossJoin(F.broadcast(_vectors(spark, d).select(F.posexplode("a").alias("i", "x")).groupBy("i").agg((F.avg("x") + 2).alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("b"))))
        .select("vec_id", F.round(A.total(F.zip_with("a", "b", {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y}[op])), 4).alias("total"))
    )

query("sum_all", f"SELECT round(sum(list_sum(a)), 3) AS total, round(avg(list_sum(a) / len(a)), 6) AS mean_value FROM {_E}")(
    lambda spark, d: _vectors(spark, d).select(A.total(F.col("a")).alias("s"), F.size("a").alias("n")).agg(F.round(F.sum("s"), 3).alias("total"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_value"))
)
for _name, _f in (("sum_axis", "sum"), ("mean_axis", "avg")):
    query(_name, f"SELECT i - 1 AS pos, round({_f}(a[i]), 5) AS value FROM {_E} t, unnest(range(1, len(a) + 1)) u(i) GROUP BY i")(
        lambda spark, d, f=_f: _vectors(spark, d).select(F.posexplode("a").alias("pos", "x")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(getattr(F, f)("x"), 5).alias("value"))
    )
query("softmax", f"SELECT vec_id, round(list_max(list_transform(a, lambda x: exp(x - list_max(a)) / list_sum(list_transform(a, lambda y: exp(y - list_max(a)))))), 6) AS top FROM {_E}")(
    lambda spark, d: _vectors(spark, d).select("vec_id", F.round(F.array_max(A.softmax(F.col("a"))), 6).alias("top"))
)
query("log_softmax", f"SELECT vec_id, round(a[1] - list_max(a) - ln(list_sum(list_transform(a, lambda y: exp(y - list_max(a))))), 6) AS head FROM {_E}")(
    lambda spark, d: _vectors(spark, d).select("vec_id", F.round(F.get(A.log_softmax(F.col("a")), F.lit(0)), 6).alias("head"))
)
query("cross_entropy", f"SELECT round(avg(list_max(a) + ln(list_sum(list_transform(a, lambda y: exp(y - list_max(a))))) - a[label % len(a) + 1]), 6) AS loss FROM {_E}")(
    lambda spark, d: _vectors(spark, d).agg(F.round(F.avg(-F.get(A.log_softmax(F.col("a")), F.col("label") % F.size("a"))), 6).alias("loss"))
)
query("rms_norm", f"SELECT vec_id, round(a[1] / sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a) + 1e-5), 6) AS head FROM {_E}")(
    lambda spark, d: _vectors(spark, d).select("vec_id", F.round(F.get(A.rms_norm(F.col("a")), F.lit(0)), 6).alias("head"))
)
query("agg_param_stats", f"SELECT label, round(avg(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a))), 6) AS rms, count(*) AS n FROM {_E} GROUP BY label")(
    lambda spark, d: _vectors(spark, d).groupBy("label").agg(F.round(F.avg(A.l2_norm(F.col("a")) / F.sqrt(F.size("a"))), 6).alias("rms"), F.count("*").alias("n"))
)
query("agg_global_norm", f"SELECT round(sqrt(sum(list_sum(list_transform(a, lambda x: x * x)))), 5) AS norm FROM {_E}")(
    lambda spark, d: _vectors(spark, d).agg(F.round(F.sqrt(F.sum(A.total(F.transform("a", lambda x: x * x)))), 5).alias("norm"))
)
query("clip_global_norm", f"WITH g AS (SELECT sqrt(sum(list_sum(list_transform(a, lambda x: x * x)))) AS n FROM {_E}) SELECT vec_id, round(a[1] * least(1.0, 1.0 / n), 6) AS head FROM {_E} t, g")(
    lambda spark, d: _vectors(spark, d)
    .crossJoin(F.broadcast(_vectors(spark, d).agg(F.sqrt(F.sum(A.total(F.transform("a", lambda x: x * x)))).alias("n"))))
    .select("vec_id", F.round(F.get("a", F.lit(0)) * F.least(F.lit(1.0), 1.0 / F.col("n")), 6).alias("head"))
)
query("agg_accuracy", f"SELECT round(avg((list_position(a, list_max(a)) - 1 = label % len(a))::INT), 6) AS accuracy FROM {_E}")(
    lambda spark, d: _vectors(spark, d).agg(F.round(F.avg((F.array_position("a", F.array_max("a")) - 1 == F.col("label") % F.size("a")).cast("int")), 6).alias("accuracy"))
)


def column_products(v):
    """(i, j, n, x, y, xy): for every two columns of whole vectors the rows, both sums and the sum of products; each batch is one product of matrices."""

    def run(batches):
        for batch in batches:
            a = batch.column("a")
            if not len(a):
                continue
            m = np.array(a.flatten().to_numpy(zero_copy_only=False), float).reshape(len(a), -1)
            xy, x = m.T @ m, m.sum(axis=0)
            i, j = np.indices(xy.shape)
            columns = (i.ravel(), j.ravel(), np.full(xy.size, len(m)), x[i.ravel()], x[j.ravel()], xy.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(columns)], names=["i", "j", "n", "x", "y", "xy"])

    parts = v.where("a is not null").select("a").mapInArrow(run, "i long, j long, n long, x double, y double, xy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])


_CELLS = "unnest(range(1, len(a) + 1)) u(i), unnest(range(1, len(a) + 1)) w(j)"
query("matmul", f"SELECT i - 1 AS i, j - 1 AS j, round(sum(a[i] * a[j]), 4) AS value FROM {_E} t, {_CELLS} GROUP BY 1, 2")(
    lambda spark, d: column_products(_vectors(spark, d)).select("i", "j", F.round("xy", 4).alias("value"))
)
query("agg_covariance", f"SELECT i - 1 AS i, j - 1 AS j, round(covar_pop(a[i], a[j]), 6) + 0.0 AS cov FROM {_E} t, {_CELLS} WHERE i <= j GROUP BY 1, 2")(
    lambda spark, d: column_products(_vectors(spark, d)).where("i <= j").select("i", "j", (F.round(F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n"), 6) + 0.0).alias("cov"))
)


def _pca(spark, d):
    """The two directions of greatest variance: the covariances are one matrix of the vectors' width, whatever the number of vectors."""
    cells = column_products(_vectors(spark, d)).collect()
    width = 1 + max((c["i"] for c in cells), default=-1)
    cov, mean = np.zeros((width, width)), np.zeros(width)
    for c in cells:
        cov[c["i"], c["j"]] = c["xy"] / c["n"] - c["x"] / c["n"] * c["y"] / c["n"]
        mean[c["i"]] = c["x"] / c["n"]
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2].T if width else np.zeros((2, 0))
    axes = [(a * (1 if a[np.abs(a).argmax()] >= 0 else -1)).tolist() for a in axes]  # signs are free: the largest part is positive
    project = lambda axis: A.total(F.zip_with("a", F.lit(axis), lambda x, w: x * w)) - float(np.dot(mean, axis))
    return _vectors(spark, d).select("vec_id", F.round(project(axes[0]), 5).alias("x"), F.round(project(axes[1]), 5).alias("y"))


query("pca2")(_pca)
sql_query("transpose", "SELECT pos, count(*) AS n, round(sum(x * (vec_id % 7)), 4) AS mark FROM (SELECT vec_id, posexplode(transform(embedding, e -> CAST(e AS DOUBLE))) AS (pos, x) FROM {embeddings}) GROUP BY pos",
          f"SELECT (i - 1)::INT AS pos, count(*) AS n, round(sum(a[i] * (vec_id % 7)), 4) AS mark FROM {_E} t, unnest(range(1, len(a) + 1)) u(i) GROUP BY i")
sql_query("narrow", "SELECT vec_id, round(aggregate(slice(transform(embedding, e -> CAST(e AS DOUBLE)), 3, 4), 0D, (t, x) -> t + x), 6) AS part FROM {embeddings}",
          f"SELECT vec_id, round(list_sum(list_slice(a, 3, 6)), 6) AS part FROM {_E}")
sql_query("repeat_interleave", "SELECT vec_id, size(r) AS n, round(aggregate(zip_with(r, sequence(1, size(r)), (x, i) -> x * i), 0D, (t, x) -> t + x), 4) AS mark FROM (SELECT vec_id, flatten(transform(embedding, e -> array_repeat(CAST(e AS DOUBLE), 2))) AS r FROM {embeddings})",
          "SELECT vec_id, (len(a) * 2)::INT AS n, round(list_sum(list_transform(a, lambda x, i: x * (4 * i - 1))), 4) AS mark FROM " + _E)

# -- closed forms ----------------------------------------------------------------------------------

_LR = "SELECT {s} AS step, round(CASE WHEN {s} < 100 THEN 3e-4 * ({s} + 1) / 100 WHEN {s} >= 2000 THEN 3e-5 ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * ({s} - 100) / 1900.0)) END, 10) AS lr FROM range(0, 2100)"
sql_query("lr", _LR.format(s="id").replace("3e-4", "3e-4D").replace("3e-5", "3e-5D"), _LR.format(s="range").replace("3e-4", "3e-4::DOUBLE").replace("3e-5", "3e-5::DOUBLE"))
sql_query("rope", "SELECT p.id AS pos, i.id AS dim, round(cos(p.id * pow(10000D, -i.id / 8D)), 6) AS c, round(sin(p.id * pow(10000D, -i.id / 8D)), 6) AS s FROM range(64) p CROSS JOIN range(8) i",
          "SELECT p.range AS pos, i.range AS dim, round(cos(p.range * pow(10000.0::DOUBLE, -i.range / 8.0::DOUBLE)), 6) AS c, round(sin(p.range * pow(10000.0::DOUBLE, -i.range / 8.0::DOUBLE)), 6) AS s FROM range(64) p, range(8) i")
# rows: name, vocabulary, width, layers, heads, key-value heads, hidden width, tied embeddings
_MODELS = "('a', 512, 64, 2, 4, 4, 192, true), ('b', 4096, 128, 4, 4, 2, 384, true), ('c', 32000, 384, 8, 6, 2, 1024, false)"
_PARAMS = "SELECT name, CAST(v * d * CASE WHEN tied THEN 1 ELSE 2 END AS BIGINT) AS embedding, CAST(l * (2 * d * d + 2 * d * (d {div} h) * k) AS BIGINT) AS attention, CAST(l * 3 * d * f AS BIGINT) AS mlp, CAST((2 * l + 1) * d AS BIGINT) AS norms FROM {src} AS t(name, v, d, l, h, k, f, tied)"
sql_query("param_breakdown", _PARAMS.format(div="DIV", src=f"VALUES {_MODELS}"), _PARAMS.format(div="//", src=f"(VALUES {_MODELS})"))
_SHAPES = "(array(2, 3), array(3)), (array(4, 1, 5), array(7, 1)), (array(1), array(6, 2))"
sql_query("broadcast_shapes", f"SELECT array_join(reverse(zip_with(reverse(a), reverse(b), (x, y) -> greatest(coalesce(x, 1), coalesce(y, 1)))), 'x') AS shape, CAST(aggregate(a, 1, (t, x) -> t * x) AS BIGINT) AS numel FROM VALUES {_SHAPES} AS t(a, b)",
          "SELECT * FROM (VALUES ('2x3', 6::BIGINT), ('4x7x5', 20::BIGINT), ('6x2', 1::BIGINT)) AS t(shape, numel)")
_TIME = "(o_orderkey % 1000 + 0.5)"
_UNIT = "CASE o_orderkey % 6 WHEN 0 THEN 'ps' WHEN 1 THEN 'ns' WHEN 2 THEN 'us' WHEN 3 THEN 'ms' WHEN 4 THEN 's' ELSE 'eons' END"
query("to_ns", f"SELECT o_orderkey, round({_TIME}::DOUBLE * CASE o_orderkey % 6 WHEN 0 THEN 0.001 WHEN 2 THEN 1000 WHEN 3 THEN 1000000 WHEN 4 THEN 1000000000 ELSE 1 END::DOUBLE, 6) AS ns FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.round(to_ns(F.expr(_TIME), F.expr(_UNIT)), 6).alias("ns"))
)
