"""Many binary-response fits in one job sequence.

A fit is a `Problem`: which row keys (folds, periods, items) train it, its class weights, its
penalty, its scaler. All problems share the rows, so one pass serves them all: each task adds
up loss, gradient and curvature of every open problem over its rows (matrix products on Arrow
batches), the sums meet by block of problems, and the same task takes the next Newton step of
the problems of its block. No job belongs to one problem, and the number of passes is that of
the slowest one.

* Penalty: C * sum(w * loss) + ((1 - l1) / 2 * |b|^2 + l1 * |b|_1), the intercept left out unless
  it is declared one of the penalised coefficients.
* A step is a Newton step on the smooth part; with an l1 part the quadratic model is minimised
  by coordinate descent. A step that does not lower the objective is halved.
* A problem is done when its optimality residual (of the objective per unit of weight) is below
  `tol`; the residual and whether it was reached are returned with the coefficients.

Rows with equal features, label and key can be summed to one weighted cell first; for a discrete
design every pass then runs over its few cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Problems that meet in one group, and that one run of passes holds at most.
BLOCK, SLAB = 64, 4096
# Numbers of one matrix product inside a task (512 rows of it, and as many problems as fit); rows times problems of a task, about.
CHUNK, ROWS, SHARE = 1 << 15, 512, 500_000
# Rows that a task takes up at once; rows of a task, where there are more tasks than four a core.
GATHER, TASK_ROWS = 1 << 16, 1 << 18

@dataclass(frozen=True)
class Problem:
    """One fit; keys are compared as text, and None means every row."""
    train: frozenset | None = None
    test: frozenset | None = None
    c: float | None = None
    l1: float = 0.0
    weights: object = None  # None, 'balanced', or (weight of label 0, weight of label 1)
    fit_intercept: bool = True
    penal_intercept: bool = False
    centre: tuple | None = None
    scale: tuple | None = None
    active: tuple | None = None  # which of (intercept, *features) may differ from nought


@dataclass
class Fits:
    """Coefficients (intercept first) on the features as given, one row per problem."""
    features: list[str]
    problems: list[Problem]
    keys: list[str]
    beta: np.ndarray
    residual: np.ndarray
    converged: np.ndarray
    passes: int
    curvature: np.ndarray | None = None  # of the first problem's loss at its solution

    def margin(self, k: int) -> Column:
        """Linear predictor of problem k as a column expression."""
        out = F.lit(float(self.beta[k, 0]))
        for f, b in zip(self.features, self.beta[k, 1:], strict=True):
            if b != 0:
                out = out + F.col(f"`{f}`") * F.lit(float(b))
        return out


def cells(df: DataFrame, features: list[str], label: str, key: str | None = None, weight: str | None = None,
          group: bool = False, extra: tuple[str, ...] = (), with_id: bool = False) -> DataFrame:
    """(_x0.., _y, _key, extra.., _w): the rows, or with `group` one weighted row per distinct combination.

    `with_id` adds a long `_id` before `_w` by which rows can be drawn: a hash of the row_key column or,
    without one, of the whole row. A null feature or label fails the job.
    """
    def known(c):
        value = F.col(f"`{c}`").cast("double")
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"null in the column {c}")).cast("double"))
    columns = [*[known(c).alias(f"_x{i}") for i, c in enumerate(features)], known(label).alias("_y"),
               (F.col(f"`{key}`").cast("string") if key else F.lit("")).alias("_key"), *[F.col(f"`{c}`") for c in extra]]
    one = (F.col(f"`{weight}`") if weight else F.lit(1.0)).cast("double").alias("_w")
    if with_id and not group:
        ident = ["row_key"] if "row_key" in df.columns else df.columns
        columns.append(F.xxhash64(*[F.col(f"`{c}`") for c in ident]).alias("_id"))
    rows = df.select(*columns, one)
    if group:
        rows = rows.groupBy(*[c for c in rows.columns if c != "_w"]).agg(F.sum("_w").alias("_w"))
    return rows


def log_normal_tail(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-log of the normal distribution function at t, its density over it)."""
    far = t < -30
    inner = -np.where(far, -30.0, t) / math.sqrt(2)
    tail = 0.5 * np.fromiter(map(math.erfc, inner.ravel().tolist()), float, inner.size).reshape(inner.shape)
    density = np.exp(-0.5 * t * t) / math.sqrt(2 * math.pi)
    z = np.where(far, t, -30.0)
    ratio = np.where(far, -z * (1 + 1 / (z * z) - 2 / z ** 4), density / np.maximum(tail, 1e-300))
    loss = np.where(far, 0.5 * z * z + 0.5 * math.log(2 * math.pi) + np.log(ratio), -np.log(np.maximum(tail, 1e-300)))
    return loss, ratio


def loss_terms(link: str, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, minus its slope, and its curvature in t, the margin towards a row's own label."""
    if link == "logit":
        p = np.where(t > 0, np.exp(-np.abs(t)), 1.0) / (1 + np.exp(-np.abs(t)))
        return np.logaddexp(0, -t), p, p * (1 - p)
    loss, ratio = log_normal_tail(t)
    return loss, ratio, ratio * (ratio + t)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = np.empty((batch.num_rows, width + 1))
    x[:, 0] = 1.0
    for i in range(width):
        x[:, i + 1] = batch.column(i).to_numpy(zero_copy_only=False)
    return x


def _class_sums(link: str, xs: np.ndarray, ws: np.ndarray | None, beta: np.ndarray) -> np.ndarray:
    """Sums of loss, gradient and curvature of each row of `beta` over rows of one label; xs: margins towards that label."""
    p = xs.shape[1]
    at_i, at_j = np.triu_indices(p)
    total = np.zeros((len(beta), 1 + p + len(at_i)))
    for lo in range(0, len(xs), ROWS):
        x = xs[lo:lo + ROWS]
        w = None if ws is None else ws[lo:lo + ROWS]
        products = x[:, at_i] * x[:, at_j]
        weighed, products = (x, products) if w is None else (x * w[:, None], products * w[:, None])
        step = max(1, CHUNK // len(x))
        for at in range(0, len(beta), step):
            js = slice(at, at + step)
            t = x @ beta[js].T
            if link == "logit":
                loss, slope, curve = _logit_sums(t, w)
            else:
                loss, slope, curve = loss_terms(link, t)
                loss = loss.sum(0) if w is None else w @ loss
            total[js, 0] += loss
            total[js, 1:1 + p] -= slope.T @ weighed
            total[js, 1 + p:] += curve.T @ products
    return total


def _logit_sums(t: np.ndarray, w: np.ndarray | None):
    """`loss_terms` of the logit with the loss summed over the rows, by its logarithm of a product where all weights are one."""
    e = np.exp(-np.abs(t))
    e += 1
    low = np.minimum(t, 0)
    if w is None:  # factors of at most two each, of at most ROWS rows
        loss = np.log(np.multiply.reduce(e, 0)) - low.sum(0)
    else:
        loss = w @ (np.log(e) - low)
    slope = np.exp(np.minimum(t, 700.0, out=low), out=low)
    slope += 1
    np.reciprocal(slope, out=slope)
    return loss, slope, slope * (1 - slope)


def _sums(shared, width: int, link: str):
    """Per block of problems: loss, gradient and curvature sums over the task's rows."""
    def run(batches):
        state = shared.value
        beta, mask, weights, keys = state["beta"], state["mask"], state["weights"], pa.array(state["keys"], pa.string())
        count, p = beta.shape
        total = np.zeros((count, 1 + p + p * (p + 1) // 2))
        # problems at the same coefficients (all of them, in the first pass) share their sums over a key and label
        distinct, number = np.unique(beta, axis=0, return_inverse=True)
        number = number.reshape(-1)
        for part in _gathered(batches, GATHER):
            x, y, w = _matrix(part, width), part.column(width).to_numpy(), part.column(part.num_columns - 1).to_numpy()
            place = pc.fill_null(pc.index_in(part.column(width + 1), value_set=keys), -1).to_numpy()
            plain = bool((w == 1).all())
            for k in np.unique(place[place >= 0]):
                js = np.flatnonzero(mask[:, k])
                some, spot = np.unique(number[js], return_inverse=True)
                for c in (0, 1):
                    rows = np.flatnonzero((place == k) & ((y > 0.5) == bool(c)))
                    if len(rows) and len(js):
                        found = _class_sums(link, x[rows] * (2.0 * c - 1), None if plain else w[rows], distinct[some])
                        total[js] += weights[js, c][:, None] * found[spot.reshape(-1)]
        for at in range(0, count, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()),
                                              pa.array([total[at:at + BLOCK].tobytes()], pa.binary())], ["block", "sums"])
    return run


def _gathered(batches, least: int):
    """The rows of the batches in batches of `least` rows or more, but for the last."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _step(state: dict, block: int, total: np.ndarray) -> dict:
    """The next candidate of each problem of a block (arrays over its problems)."""
    part = slice(block * BLOCK, block * BLOCK + len(total))
    theta, best, f_best, kkt_best = (state[k][part] for k in ("theta", "best", "f_best", "kkt_best"))
    n, p = theta.shape
    at_i, at_j = np.triu_indices(p)
    hess = np.zeros((n, p, p))
    hess[:, at_i, at_j] = total[:, 1 + p:]
    hess[:, at_j, at_i] = total[:, 1 + p:]
    shift, scale, size = state["shift"][part], state["scale"][part], state["size"][part]
    lam, l1, pen, active = state["lam"][part], state["l1"][part], state["pen"][part], state["active"][part]
    # to the scaled coordinates of each problem
    back = np.zeros((n, p, p))
    back[:, np.arange(p), np.arange(p)] = 1 / scale
    back[:, 0, 1:] = -shift[:, 1:] / scale[:, 1:]
    grad = np.einsum("nji,nj->ni", back, total[:, 1:1 + p]) / size[:, None]
    curv = np.einsum("nji,njk,nkl->nil", back, hess, back) / size[:, None, None]
    ridge, lasso = (lam * (1 - l1))[:, None] * pen, (lam * l1)[:, None] * pen
    f = total[:, 0] / size + (ridge * theta ** 2 / 2 + lasso * np.abs(theta)).sum(1)
    grad = (grad + ridge * theta) * active
    curv[:, np.arange(p), np.arange(p)] += ridge
    slack = np.where(theta != 0, np.abs(grad + lasso * np.sign(theta)), np.maximum(np.abs(grad) - lasso, 0)) * active
    kkt = slack.max(1)
    better = f <= f_best + 1e-13 * np.maximum(1, np.abs(f_best))
    direction = np.zeros((n, p))
    todo = np.flatnonzero(better & (kkt > state["tol"]))
    if len(todo):
        direction[todo] = _direction(theta[todo], grad[todo], curv[todo], lasso[todo], active[todo])
    return {"best": np.where(better[:, None], theta, best), "f_best": np.where(better, f, f_best),
            "kkt_best": np.where(better, kkt, kkt_best),
            "theta": np.where(better[:, None], theta + direction, (best + theta) / 2), "better": better,
            "curv": total[:, 1 + p:]}


def _direction(theta, grad, curv, lasso, active):
    """Minimiser of grad d + d curv d / 2 + lasso |theta + d| per problem; nought where not active."""
    n, p = theta.shape
    off = active[:, :, None] * active[:, None, :]
    curv = curv * off
    diagonal = np.einsum("nii->ni", curv)
    root = np.where(diagonal > 0, 1 / np.sqrt(np.maximum(diagonal, 1e-300)), 0.0)
    smooth = ~(lasso > 0).any(1)
    out = np.zeros((n, p))
    if smooth.any():
        even = curv[smooth] * root[smooth][:, :, None] * root[smooth][:, None, :]
        inverse = np.linalg.pinv(even, rcond=1e-11, hermitian=True)
        out[smooth] = -root[smooth] * np.einsum("nij,nj->ni", inverse, root[smooth] * grad[smooth])
    rest = np.flatnonzero(~smooth)
    if len(rest):
        t, g, h, l, d = theta[rest], grad[rest], curv[rest], lasso[rest], diagonal[rest]
        move = np.zeros_like(t)
        hd = np.zeros_like(t)  # h @ move
        for _ in range(500):
            largest = 0.0
            for j in range(p):
                a = np.where(d[:, j] > 0, d[:, j], 1.0)
                z = t[:, j] + move[:, j] - (g[:, j] + hd[:, j]) / a
                new = np.sign(z) * np.maximum(np.abs(z) - l[:, j] / a, 0) - t[:, j]
                change = np.where(d[:, j] > 0, new - move[:, j], 0.0)
                move[:, j] += change
                hd += h[:, :, j] * change[:, None]
                largest = max(largest, float(np.abs(change * np.sqrt(a)).max()))
            if largest < 1e-13:
                break
        out[rest] = move
    return out * active


def _stepped(shared, width: int):
    names = ("best", "f_best", "kkt_best", "theta", "better", "curv")

    def run(key, table):
        state = shared.value
        block = key[0].as_py()
        size = min(BLOCK, len(state["theta"]) - block * BLOCK)
        total = sum(np.frombuffer(b, float).reshape(size, -1) for b in table.column("sums").to_pylist())
        found = _step(state, block, total)
        keep = names if state["curvature"] else names[:-1]
        packed = b"".join(np.ascontiguousarray(found[n].reshape(size, -1), float).tobytes() for n in keep)
        return pa.table({"block": pa.array([block], pa.int32()), "state": pa.array([packed], pa.binary())})
    return run


def balanced_weights(p, counts: dict) -> tuple[float, float]:
    """The weights of labels 0 and 1 of a problem, from the row counts per (key, label)."""
    if p.weights is None:
        return 1.0, 1.0
    if p.weights != "balanced":
        return float(p.weights[0]), float(p.weights[1])
    by = [sum(n for (k, y), n in counts.items() if y == c and (p.train is None or k in p.train)) for c in (0, 1)]
    present = sum(n > 0 for n in by)
    return tuple(sum(by) / (present * n) if n else 1.0 for n in by)


def solve(rows: DataFrame, features: list[str], problems: list[Problem], link: str = "logit", tol: float = 1e-10,
          max_passes: int = 100, curvature: bool = False) -> Fits:
    """Fit all problems on `rows`, a table of `cells`; persist it first if it is costly to read again."""
    spark = rows.sparkSession
    width, p = len(features), len(features) + 1
    found = rows.groupBy("_key", (F.col("_y") > 0.5).cast("int").alias("_c")).agg(
        F.sum("_w").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    counts = {(r["_key"], int(r["_c"])): float(r["n"]) for r in found}
    keys = sorted({k for k, _ in counts})
    given = rows
    rows = dealt(rows, sum(r["rows"] for r in found), min(len(problems), SLAB), 4 * spark.sparkContext.defaultParallelism)
    if rows is not given:
        rows = kept(rows)
    beta, residual, converged, passes, last = [], [], [], 0, None
    for lo in range(0, len(problems), SLAB):
        part = problems[lo:lo + SLAB]
        n = len(part)
        mask = np.array([[q.train is None or k in q.train for k in keys] for q in part]).reshape(n, len(keys))
        weights = np.array([balanced_weights(q, counts) for q in part]).reshape(n, 2)
        size = np.array([sum(m * w for (k, c), m in counts.items() if mask[j, keys.index(k)] for w in [weights[j, c]])
                         for j in range(n)])
        state = {
            "shift": np.array([(0.0, *(q.centre or (0.0,) * width)) for q in part]),
            "scale": np.array([(1.0, *(q.scale or (1.0,) * width)) for q in part]), "size": np.maximum(size, 1e-300),
            "lam": np.array([0.0 if q.c is None else 1.0 / (q.c * max(s, 1e-300)) for q, s in zip(part, size, strict=True)]),
            "l1": np.array([q.l1 for q in part]), "pen": np.array([[float(q.penal_intercept)] + [1.0] * width for q in part]),
            "active": np.array([q.active or (q.fit_intercept,) + (True,) * width for q in part], float),
            "best": np.zeros((n, p)), "theta": np.zeros((n, p)), "f_best": np.full(n, np.inf), "kkt_best": np.full(n, np.inf),
            "keys": keys, "weights": weights, "tol": tol, "curvature": curvature}
        live, halved = size > 0, np.zeros(n, int)
        curv = np.zeros((n, p * (p + 1) // 2))
        for _ in range(max_passes):
            if not live.any():
                break
            passes += 1
            raw = state["theta"] / state["scale"]
            raw[:, 0] -= (state["theta"][:, 1:] * state["shift"][:, 1:] / state["scale"][:, 1:]).sum(1)
            # only the open problems travel
            at = np.flatnonzero(live)
            sent = {k: (v[at] if isinstance(v, np.ndarray) else v) for k, v in state.items()}
            shared = spark.sparkContext.broadcast(sent | {"beta": raw[at], "mask": mask[at]})
            moved = (rows.mapInArrow(_sums(shared, width, link), "block int, sums binary").groupBy("block")
                     .applyInArrow(_stepped(shared, width), "block int, state binary").collect())
            for r in moved:
                spot = at[r["block"] * BLOCK:(r["block"] + 1) * BLOCK]
                m, flat, cut = len(spot), np.frombuffer(bytes(r["state"]), float), 0
                for name, cols in (("best", p), ("f_best", 1), ("kkt_best", 1), ("theta", p), ("better", 1), *([("curv", curv.shape[1])] if curvature else [])):
                    value = flat[cut:cut + m * cols].reshape(m, cols)
                    cut += m * cols
                    if name == "better":
                        halved[spot] = np.where(value[:, 0] > 0, 0, halved[spot] + 1)
                    elif name == "curv":
                        curv[spot] = np.where(halved[spot][:, None] == 0, value, curv[spot])
                    else:
                        state[name][spot] = value if cols > 1 or state[name].ndim > 1 else value[:, 0]
            shared.destroy()
            live &= (state["kkt_best"] > tol) & (halved < 40)
        theta = state["best"]
        raw = theta / state["scale"]
        raw[:, 0] -= (theta[:, 1:] * state["shift"][:, 1:] / state["scale"][:, 1:]).sum(1)
        beta.append(raw)
        residual.append(np.where(np.isfinite(state["kkt_best"]), state["kkt_best"], np.nan))
        converged.append(state["kkt_best"] <= tol)
        last = curv if last is None else last
    if rows is not given:
        rows.unpersist()
    square = None
    if curvature and last is not None and len(last):
        square = np.zeros((p, p))
        at_i, at_j = np.triu_indices(p)
        square[at_i, at_j] = square[at_j, at_i] = last[0]
    empty = np.empty((0, p))
    return Fits(list(features), list(problems), keys, np.concatenate(beta) if beta else empty,
                np.concatenate(residual) if residual else empty[:, 0], np.concatenate(converged) if converged else empty[:, 0] > 0,
                passes, square)


def scores(rows: DataFrame, fits: Fits, digits: int | None = None) -> DataFrame:
    """(problem, y, score, weight): the logit scores of each problem's test rows, of all problems in one pass."""
    each = scored(rows, fits)

    def run(batches):
        for js, y, p, w in each(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(js, len(y)).astype(np.int32)), pa.array(np.tile(y, len(js)).astype(np.int32)),
                 pa.array(p.ravel()), pa.array(np.tile(w, len(js)).astype(np.int64))], ["problem", "y", "score", "weight"])
    out = rows.mapInArrow(run, "problem int, y int, score double, weight long")
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def scored(rows: DataFrame, fits: Fits):
    """A task function: from batches of `rows` to (problems, labels, scores by problem and row, weights) of test rows."""
    width = len(fits.features)
    mask = np.array([[q.test is None or k in q.test for k in fits.keys] for q in fits.problems]).reshape(len(fits.problems), -1)
    shared = rows.sparkSession.sparkContext.broadcast((fits.beta, mask, fits.keys))

    def each(batches):
        beta, used, keys = shared.value
        keys = pa.array(keys, pa.string())
        for batch in batches:
            place = pc.fill_null(pc.index_in(batch.column(width + 1), value_set=keys), -1).to_numpy()
            x, y, w = _matrix(batch, width), batch.column(width).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            for k in np.unique(place[place >= 0]):
                at = np.flatnonzero(place == k)
                chosen = np.flatnonzero(used[:, k])
                step = max(1, (1 << 18) // len(at))
                columns = [np.ascontiguousarray(x[at, i]) for i in range(1, width + 1)]
                for lo in range(0, len(chosen), step):
                    js = chosen[lo:lo + step]
                    # column by column: a matrix product may round equal rows otherwise by their place, which breaks ties
                    t = np.repeat(-beta[js, :1], len(at), 1)
                    for i, column in enumerate(columns):
                        t -= beta[js, i + 1][:, None] * column
                    with np.errstate(over="ignore"):
                        p = 1 / (1 + np.exp(t))
                    yield js, y[at], p, w[at]
    return each


def kept(rows: DataFrame) -> DataFrame:
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def dealt(rows: DataFrame, count: int, problems: int, most: int | None = None) -> DataFrame:
    """The rows in as many partitions as the work of a pass asks for: rows times problems, SHARE in each.

    Small tables come in one partition, however many problems read them and however many partitions made them. With
    `most`, more partitions than that hold TASK_ROWS rows or more each, since each task's sums are sent on; rows that lie
    in about as many partitions stay where they are.
    """
    wanted, there = max(1, min(-(-count // 1000), -(-count * problems // SHARE))), rows.rdd.getNumPartitions()
    if most is not None and wanted > most:
        wanted = max(most, min(wanted, -(-count // TASK_ROWS)))
        if most <= 2 * there and there <= 2 * wanted:
            return rows
    if wanted == there:
        return rows
    return rows.repartition(wanted) if wanted > there else rows.coalesce(wanted)
