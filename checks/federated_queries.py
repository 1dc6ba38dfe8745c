"""Federated training, aggregation strategies, scores and alarms."""

from pyspark.sql import functions as F

from checks.feature_queries import ALL_VIEWS, SCALED, rounded, rsql, tables
from checks.registry import query, with_views
from lateline.operators import audits
from lateline.operators import federated as fed
from lateline.plans.federation_run import (
    compare_with_local, federated_rounds,
)
from lateline.session import materialize

ROUNDS, EPOCHS = 2, 2

SPLIT = SCALED + """,
  ranked AS (
    SELECT client, "window", x, row_number() OVER (PARTITION BY client ORDER BY "window") AS rn,
      count(*) OVER (PARTITION BY client) AS n
    FROM seqs WHERE split = 'train'),
  halves AS (
    SELECT client, "window", flatten(x) AS x,
      CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS part
    FROM ranked WHERE n >= 10)"""
MOMENTS = SPLIT + """,
  cells AS (
    SELECT client, part, "window", CAST(unnest(x) AS DOUBLE) AS value,
      CAST(unnest(range(0, 88)) AS INT) AS i FROM halves),
  moments AS (
    SELECT a.client, a.part, a.i, b.i AS j, count(*) AS n, sum(a.value) AS total,
      sum(a.value * b.value) AS product
    FROM cells a JOIN cells b ON b.client = a.client AND b.part = a.part
      AND b."window" = a."window" GROUP BY ALL)"""


HIDDEN = fed.HIDDEN


def reconstruct(name, a, b, gram="gram"):
    """BA and (I - BA) G of weights ``a`` (client, k, i) and ``b`` (client, i, k)."""
    return f"""
  {name}_ba AS MATERIALIZED (
    SELECT b.client, b.i, a.i AS j, sum(b.value * a.value) AS value
    FROM {b} b JOIN {a} a ON a.client = b.client AND a.k = b.k GROUP BY ALL),
  {name}_rest AS MATERIALIZED (
    SELECT x.client, x.i, g.j, g.n,
      sum((CASE WHEN x.i = x.j THEN 1 ELSE 0 END - x.value) * g.value) AS value
    FROM {name}_ba x JOIN {gram} g ON g.client = x.client AND g.i = x.j GROUP BY ALL)"""


def loss_sql(name, a, b, gram="gram"):
    return reconstruct(name, a, b, gram) + f""",
  {name}_loss AS MATERIALIZED (
    SELECT r.client, any_value(r.n) AS n,
      sum((CASE WHEN r.i = r.j THEN 1 ELSE 0 END - x.value) * r.value) / 88 AS loss
    FROM {name}_rest r JOIN {name}_ba x ON x.client = r.client AND x.i = r.i AND x.j = r.j
    GROUP BY r.client)"""


def epochs_sql(name, a0, b0, epochs, mu=0.0):
    """Gradient steps from ``a0``, ``b0``; the result is ``{name}_a`` and ``{name}_b``."""
    parts, a, b = [], a0, b0
    for e in range(1, epochs + 1):
        step = f"{name}_{e}"
        new_a, new_b = (f"{name}_a", f"{name}_b") if e == epochs else (f"{step}_a", f"{step}_b")
        parts.append(reconstruct(step, a, b) + f""",
  {new_a} AS MATERIALIZED (
    SELECT w.client, w.k, w.i, w.value - rate * (-2 * g.value / 88
      + {mu} * (w.value - z.value)) AS value
    FROM {a} w JOIN {a0} z ON z.client = w.client AND z.k = w.k AND z.i = w.i
    JOIN (SELECT b.client, b.k, r.j AS i, sum(b.value * r.value) AS value
          FROM {b} b JOIN {step}_rest r ON r.client = b.client AND r.i = b.i GROUP BY ALL) g
      ON g.client = w.client AND g.k = w.k AND g.i = w.i
    JOIN (SELECT client, step / (1 + step * {mu}) AS rate FROM steps) s ON s.client = w.client),
  {new_b} AS MATERIALIZED (
    SELECT w.client, w.i, w.k, w.value - rate * (-2 * g.value / 88
      + {mu} * (w.value - z.value)) AS value
    FROM {b} w JOIN {b0} z ON z.client = w.client AND z.k = w.k AND z.i = w.i
    JOIN (SELECT r.client, r.i, a.k, sum(r.value * a.value) AS value
          FROM {step}_rest r JOIN {a} a ON a.client = r.client AND a.i = r.j GROUP BY ALL) g
      ON g.client = w.client AND g.k = w.k AND g.i = w.i
    JOIN (SELECT client, step / (1 + step * {mu}) AS rate FROM steps) s ON s.client = w.client)""")
        a, b = new_a, new_b
    return ",".join(parts)


def average_sql(name, source):
    """The weighted mean of all clients' ``source`` weights, given to every client."""
    return ",".join(f"""
  {name}_{m} AS MATERIALIZED (
    SELECT c.client, w.k, w.i, w.value FROM (
      SELECT k, i, sum(n * value) / sum(n) AS value
      FROM {source}_{m} u JOIN sizes z ON z.client = u.client GROUP BY k, i) w, sizes c)"""
                    for m in "ab")


def start_sql(layer, idx, name, order):
    return f"""
  {name} AS MATERIALIZED (
    SELECT client, {order}, ((({idx}) * ({idx}) * ({layer} + 31) + ({idx}) * 104729
        + {layer} * 1299709) % 1000003 / CAST(1000003 AS DOUBLE) - 0.5) / sqrt(88) AS value
    FROM sizes, (SELECT unnest(range(0, {HIDDEN})) AS k) x, (SELECT unnest(range(0, 88)) AS i) y)"""


TRAINING = MOMENTS + """,
  gram AS MATERIALIZED (
    SELECT client, i, j, n, product / n AS value FROM moments WHERE part = 'train'),
  val_gram AS MATERIALIZED (
    SELECT client, i, j, n, product / n AS value FROM moments WHERE part = 'val'),
  sizes AS (SELECT client, any_value(n) AS n FROM gram GROUP BY client),
  steps AS (SELECT client, 0.5 * 88 / sqrt(sum(value * value)) AS step FROM gram GROUP BY client),
""" + start_sql(0, "k * 88 + i", "w0_a", "k, i") + "," + start_sql(
    1, f"i * {HIDDEN} + k", "w0_b", "i, k")


def weights_sql(name):
    return (f"SELECT client, 0 AS layer, CAST(k * 88 + i AS INT) AS idx, value FROM {name}_a "
            f"UNION ALL SELECT client, 1, CAST(i * {HIDDEN} + k AS INT), value FROM {name}_b")


def rounds_sql():
    parts, start = [], "w0"
    for r in range(1, ROUNDS + 1):
        parts += [epochs_sql(f"u{r}", f"{start}_a", f"{start}_b", EPOCHS),
                  loss_sql(f"t{r}", f"u{r}_a", f"u{r}_b"), average_sql(f"w{r}", f"u{r}"),
                  loss_sql(f"v{r}", f"w{r}_a", f"w{r}_b", "val_gram")]
        start = f"w{r}"
    return ",".join(parts)


def split(v):
    seqs = materialize(tables(v).sequences.where(F.col("split") == "train"), "sequences")
    return fed.client_split(seqs)


def moments(v):
    return materialize(fed.client_moments(split(v)), "moments")


@query("F1_client_split", with_views(
    ALL_VIEWS, 'SELECT client, "window", part FROM halves', SPLIT))
def _(v):
    return split(v).select("client", "window", "part")


@query("F2_client_moments", with_views(ALL_VIEWS, f"""
    SELECT client, part, i, j, n, round(total, 2) + 0.0 AS total,
      round(product, 2) + 0.0 AS product FROM moments""", MOMENTS))
def _(v):
    return fed.client_moments(split(v)).select(
        "client", "part", "i", "j", "n", (F.round("total", 2) + F.lit(0.0)).alias("total"),
        (F.round("cross", 2) + F.lit(0.0)).alias("product"))


@query("F3_local_update", with_views(ALL_VIEWS, f"""
    SELECT w.client, layer, idx, {rsql('value')}, n AS n_examples, {rsql('loss')}
    FROM ({weights_sql('u')}) w JOIN t_loss l ON l.client = w.client""",
    TRAINING + "," + epochs_sql("u", "w0_a", "w0_b", EPOCHS) + "," + loss_sql("t", "u_a", "u_b")))
def _(v):
    train = moments(v).where(F.col("part") == "train")
    return rounded(fed.local_update(train, fed.initial_weights(train), EPOCHS), "value", "loss")


@query("F4_fedavg", with_views("updates", f"""
    SELECT layer, idx, {rsql('value')} FROM (
      SELECT layer, idx, sum(n_examples * value) / sum(n_examples) AS value
      FROM updates GROUP BY layer, idx) x"""))
def _(v):
    return rounded(fed.fedavg(v.updates), "value")


@query("F5_fedmedian", with_views(
    "updates", "SELECT layer, idx, median(value) AS value FROM updates GROUP BY layer, idx"))
def _(v):
    return fed.fedmedian(v.updates)


@query("F6_fedtrimmed", with_views("updates", f"""
    SELECT layer, idx, {rsql('value')} FROM (
      SELECT layer, idx, avg(value) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY layer, idx ORDER BY value, client) AS rank,
          count(*) OVER (PARTITION BY layer, idx) AS n FROM updates) r
      WHERE rank > floor(0.2 * n) AND rank <= n - floor(0.2 * n) GROUP BY layer, idx) x"""))
def _(v):
    return rounded(fed.fedtrimmed(v.updates), "value")


@query("F7_fedprox", with_views(ALL_VIEWS, f"""
    SELECT DISTINCT layer, idx, {rsql('value')} FROM ({weights_sql('w')}) x""",
    TRAINING + "," + epochs_sql("u", "w0_a", "w0_b", EPOCHS, 0.1) + "," + average_sql("w", "u")))
def _(v):
    train = moments(v).where(F.col("part") == "train")
    return rounded(fed.fedavg(fed.local_update(train, fed.initial_weights(train), EPOCHS, mu=0.1)),
                   "value")


@query("F8_federated_rounds", with_views(ALL_VIEWS, " UNION ALL ".join(f"""
    SELECT {r} AS round, t.client, round(t.loss, 6) AS loss, round(v.loss, 6) AS validation,
      round(CAST({2 * HIDDEN * 88 * 4} AS DOUBLE) / 1048576, 6) AS mb_per_client
    FROM t{r}_loss t JOIN v{r}_loss v ON v.client = t.client""" for r in range(1, ROUNDS + 1)),
    TRAINING + "," + rounds_sql()))
def _(v):
    return rounded(federated_rounds(moments(v), "fedavg", ROUNDS, EPOCHS).history,
                   "loss", "validation", "mb_per_client")


WEIGHTS = """,
  a AS (SELECT k, i, (((k * 88 + i) * 37) % 101 - 50) / CAST(200 AS DOUBLE) AS value
        FROM (SELECT unnest(range(0, 4)) AS k) x, (SELECT unnest(range(0, 88)) AS i) y),
  b AS (SELECT i, k, (((i * 4 + k) * 53) % 97 - 48) / CAST(200 AS DOUBLE) AS value
        FROM (SELECT unnest(range(0, 4)) AS k) x, (SELECT unnest(range(0, 88)) AS i) y),
  points AS (
    SELECT client, split, "window", CAST(unnest(flatten(x)) AS DOUBLE) AS value,
      CAST(unnest(range(0, 88)) AS INT) AS i FROM seqs),
  codes AS (
    SELECT client, split, "window", k, sum(p.value * a.value) AS code
    FROM points p JOIN a ON a.i = p.i GROUP BY ALL),
  rebuilt AS (
    SELECT client, split, "window", i, sum(code * b.value) AS value
    FROM codes c JOIN b ON b.k = c.k GROUP BY ALL),
  errors AS (
    SELECT p.client, p.split, p."window", avg((r.value - p.value) ** 2) AS error
    FROM points p JOIN rebuilt r ON r.client = p.client AND r.split = p.split
      AND r."window" = p."window" AND r.i = p.i GROUP BY ALL),
  thresholds AS (
    SELECT client, quantile_cont(error, 0.995) AS threshold FROM errors
    WHERE split = 'train' GROUP BY client)"""


def errors(v):
    """Scores of all sequences under fixed weights of dimension 88 and hidden size 4."""
    cells = v.spark.range(4 * 88).select(F.col("id").cast("int").alias("idx"))
    weights = cells.select(F.lit(0).alias("layer"), "idx",
                           ((F.col("idx") * 37 % 101 - 50) / 200.0).alias("value")) \
        .unionByName(cells.select(F.lit(1).alias("layer"), "idx",
                                  ((F.col("idx") * 53 % 97 - 48) / 200.0).alias("value")))
    return fed.reconstruction_error(tables(v).sequences, weights)


def train_thresholds(scored):
    return fed.alarm_threshold(scored.where(F.col("split") == "train"))


@query("F9_reconstruction_error", with_views(ALL_VIEWS, f"""
    SELECT client, split, "window", {rsql('error')} FROM errors""", SCALED + WEIGHTS))
def _(v):
    return rounded(errors(v).select("client", "split", "window", "error"), "error")


@query("F10_alarm_threshold", with_views(
    ALL_VIEWS, f"SELECT client, {rsql('threshold')} FROM thresholds", SCALED + WEIGHTS))
def _(v):
    return rounded(train_thresholds(errors(v)), "threshold")


@query("F11_alarms", with_views(ALL_VIEWS, f"""
    SELECT e.client, split, "window", {rsql('error', 'threshold')} FROM errors e
    JOIN thresholds t ON t.client = e.client WHERE error > threshold""", SCALED + WEIGHTS))
def _(v):
    scored = materialize(errors(v).drop("x"), "errors")
    thresholds = materialize(train_thresholds(scored), "thresholds")
    return rounded(fed.alarms(scored, thresholds), "error", "threshold")


@query("F12_local_baseline", with_views(ALL_VIEWS, f"""
    SELECT f.client, round(f.loss, 6) AS federated, round(l.loss, 6) AS local,
      round(100 * (l.loss - f.loss) / l.loss, 6) + 0.0 AS gain_pct
    FROM v{ROUNDS}_loss f JOIN l_loss l ON l.client = f.client""",
    TRAINING + "," + rounds_sql() + "," + epochs_sql("own", "w0_a", "w0_b", ROUNDS * EPOCHS)
    + "," + loss_sql("l", "own_a", "own_b", "val_gram")))
def _(v):
    own = moments(v)
    return rounded(
        compare_with_local(own, federated_rounds(own, "fedavg", ROUNDS, EPOCHS), ROUNDS, EPOCHS),
        "federated", "local", "gain_pct")


@query("A20_check_fedavg", with_views("updates", """
    SELECT (SELECT count(*) FROM (SELECT DISTINCT layer, idx FROM updates) c) AS n_coordinates,
      0 AS n_off,
      (SELECT count(*) FROM (
         SELECT u.client FROM updates u JOIN (
           SELECT layer, idx, sum(n_examples * value) / sum(n_examples) AS mean
           FROM updates GROUP BY layer, idx) m ON m.layer = u.layer AND m.idx = u.idx
         GROUP BY u.client HAVING max(abs(u.value - m.mean)) <= 1e-6) s) AS n_clients_equal"""))
def _(v):
    return audits.check_fedavg(v.updates, fed.fedavg(v.updates))
