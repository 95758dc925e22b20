"""Steps that grew faster than their input, or failed on large ones: what they do now, beside plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descmap.operators import blocks, cluster, density, descriptors, fit
from descmap.operators.sampling import draw
from descmap.sources import extxyz


def test_learning_curve_takes_one_pass(spark, monkeypatch):
    """All sizes and repeats come from sums of one pass over the rows: no fit for each, no sort; a fit for each gives the same."""
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + g.normal(size=400)
    rows = [(i, v.tolist(), None if i % 50 == 7 else float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "sample_id bigint, x array<double>, y double").repartition(3)
    want = []
    d = fit.DesignMatrix(df, test_ratio=0.2)
    n = d.train.count()
    for size in sorted({20, fit.exponential_split(20, n, 3)[1], n}):
        for r in range(2 if size < n else 1):
            chosen = d.train.orderBy(draw("sample_id", f"42.{r}"), "sample_id").limit(size)
            want.append({"size": size} | fit.metrics(fit.Ridge(0.1).fit(chosen).predict(d.test), ranked=False).first().asDict())
    want = fit.learning_curve_stats(want)
    monkeypatch.setattr(fit.Ridge, "fit", lambda *a: pytest.fail("a fit for each size"))
    got = d.learning_curve(fit.Ridge(0.1), points=3, repeats=2)
    assert [sorted(a) for a in got] == [sorted(b) for b in want]
    assert all(np.isclose(a[k], b[k]) for a, b in zip(got, want, strict=True) for k in a)


def test_learning_curve_of_equal_ids(spark):
    """Rows of one id have one draw: sizes still hold."""
    df = spark.createDataFrame([(i // 40, [float(i % 7), 1.0], float(i % 5)) for i in range(400)], "sample_id bigint, x array<double>, y double")
    got = fit.DesignMatrix(df, whiten=False, test_ratio=0.3).learning_curve(fit.Ridge(0.1), points=3, repeats=2)
    n = df.where(draw("sample_id", 42) >= F.lit(0.3)).count()
    assert [g["size"] for g in got] == sorted({20, fit.exponential_split(20, n, 3)[1], n}) and all(np.isfinite(g["MAE"]) for g in got)


def many_frames(spark, n=60):
    g = np.random.default_rng(8)
    rows = []
    for k in range(n):
        m = [0, 1, 4, 7][k % 4]
        cell = (np.eye(3) * 9).tolist() if k % 10 == 3 else None
        rows.append((k, [(a, int(g.integers(1, 4)), g.normal(0, 2, 3).tolist(), {}) for a in range(m)], cell, [cell is not None] * 3))
    atom = "array<struct<idx:int,z:int,pos:array<double>,arrays:map<string,array<double>>>>"
    return spark.createDataFrame(rows, f"frame_id bigint, atoms {atom}, cell array<array<double>>, pbc array<boolean>").coalesce(1), rows


DESCRIPTORS = {
    "s": {"type": "SOAP", "species": [1, 2], "cutoff": 3.0, "n": 2, "l": 2, "sigma": 0.5},
    "a": {"type": "ACSF", "species": [1, 2, 3], "cutoff": 6.0, "g2_params": [[0.1, 1.0]], "g4_params": [[0.01, 4.0, 1.0]], "g5_params": [[0.02, 1.0, -1.0]]},
    "k": {"type": "LMBTR_K2", "species": [1, 3], "grid": {"min": 0.0, "max": 1.0, "n": 5, "sigma": 0.1}},
    "l": {"type": "LMBTR_K3", "species": [1, 2], "grid": {"n": 5}, "normalization": "l2"},
}


def test_descriptors_of_many_frames_at_once(spark):
    """Frames that don't repeat are computed together, atoms' rows and frames' sums come without the frames; as one by one."""
    df, rows = many_frames(spark)
    specs = sorted(DESCRIPTORS.values(), key=descriptors.acronym)
    want = {}
    for k, atoms, cell, pbc in rows:
        if atoms:
            f = descriptors.Frame(np.array([a[1] for a in atoms]), np.array([a[2] for a in atoms]), None if cell is None else np.array(cell), np.array(pbc))
            want[k] = np.hstack([descriptors.ATOMIC[s["type"]](f, s) for s in specs])
    got: dict = {}
    for r in descriptors.atomic_rows(df, DESCRIPTORS).orderBy("frame_id", "atom_idx").collect():
        got.setdefault(r.frame_id, []).append(r.x)
    assert sorted(got) == sorted(want) and all(np.allclose(got[k], want[k]) for k in want)
    for how, fn in (("sum", np.sum), ("average", np.mean)):
        made = {r.frame_id: r.x for r in descriptors.frame_rows(df, DESCRIPTORS, how).collect()}
        assert sorted(made) == sorted(want) and all(np.allclose(made[k], fn(want[k], axis=0)) for k in want)
    whole = {r.frame_id: r.atoms for r in descriptors.compute_atomic(df, DESCRIPTORS).collect()}
    names = [descriptors.acronym(s) for s in specs]
    assert all(np.allclose([np.concatenate([a.arrays[n] for n in names]) for a in whole[k]], want[k]) for k in want) and whole[0] == []


def test_frames_are_taken_together():
    pa = descriptors.pa
    atoms = pa.array([[{"z": 1, "pos": [0.0, 0.0, float(i)]} for i in range(5)]] * 300)
    none = pa.array([None] * 300, pa.list_(pa.list_(pa.float64())))
    got = list(descriptors._batch(atoms, none, pa.array([[False] * 3] * 300)))
    assert len(got) == 1 and got[0][2].sizes.tolist() == [5] * 300


def test_rows_are_sent_a_fixed_number_of_times(spark):
    """Twice the rows, the same number of blocks: what is shuffled grows with the rows."""
    for n in (25_000, 50_000):
        rows = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("x"))
        got = blocks.pair_blocks(rows, rows, lambda a, b: blocks.pa.table({"n": [len(a.ids)]}), "n bigint")
        assert got.agg(F.count("*"), F.sum("n")).first() == (blocks.SHARES**2, n * blocks.SHARES)


def test_tiles(spark, monkeypatch):
    """Tiles much smaller than blocks give what NumPy does for all pairs at once, equal distances and copies included."""
    monkeypatch.setattr(blocks, "TILE", (7, 5))
    x = np.round(np.random.default_rng(3).normal(size=(90, 2)), 1)
    ids = np.random.default_rng(4).permutation(1000)[:90]
    rows = blocks.Block(ids, x, {})
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(blocks.row_sums(rows, rows, lambda a, b: a @ b.T), (x @ x.T).sum(1))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "sample_id bigint, x array<double>")
    s = blocks.samples(df)
    got: dict = {}
    for r in blocks.nearest(s, s, 6).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.distance))
    for k, i in enumerate(ids.tolist()):
        want = np.lexsort((ids, np.round(d[k], 9)))[:6]
        assert np.allclose([v for _, v in got[i]], d[k][want])
    logs = {r.sample_id: r.log_density for r in density.kde(df, 0.01, "exponential").collect()}
    want = np.log(np.exp(-d / 0.01).mean(1)) - density.log_normaliser("exponential", 0.01, 2)
    assert np.allclose([logs[i] for i in ids.tolist()], want)
    labels = {r.sample_id: r.cluster_label for r in cluster.dbscan(df, 0.35, 4).collect()}
    near = d <= 0.35
    core, root = near.sum(1) >= 4, ids.copy()
    for _ in range(90):
        root = np.where(core, np.where(near & core[None, :], root[None, :], 10**9).min(1), root)
    number = {v: k for k, v in enumerate(sorted(set(root[core].tolist())))}
    for k, i in enumerate(ids.tolist()):
        own = [number[v] for v in root[near[k] & core].tolist()]
        assert labels[i] == (number[root[k]] if core[k] else min(own, default=-1))


@pytest.mark.parametrize("spec", [{"k": {"type": "linear"}}, {"k": {"type": "polynomial", "d": 3}, "c": {"type": "cosine"}}])
def test_kernel_ridge_of_many_rows(spark, spec):
    """Beyond the rows that are held in one place the fit goes by features, with the same predictions, deviations and left-out rows."""
    g = np.random.default_rng(9)
    x, y = g.normal(size=(70, 2)), g.normal(size=70)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "sample_id bigint, x array<double>, y double")
    few, many = fit.KernelRidge(0.3, spec).fit(df), fit.KernelRidge(0.3, spec).fit(df, most=50)
    get = lambda d, c: [r[c] for r in d.orderBy("sample_id").collect()]
    assert np.allclose(get(few.predict(df), "y_pred"), get(many.predict(df), "y_pred"))
    want = few.cross_validated([np.array([k]) for k in range(70)])
    assert np.allclose(want, get(few.left_out(df), "y_pred")) and np.allclose(want, get(many.left_out(df), "y_pred"))
    assert np.allclose(get(few.uncertainty(df), "y_std"), get(many.uncertainty(df), "y_std"), atol=1e-6)
    with pytest.raises(ValueError):
        fit.KernelRidge(0.3, {"k": {"type": "polynomial", "d": 2.5}}).fit(df, most=50)


@pytest.mark.parametrize("kind", [None, "exp"])
def test_density_peaks_keep_no_pairs(spark, monkeypatch, kind):
    """Nothing that is written has more rows than there are samples; a table of distances, whole or row by row, gives the same."""
    x = np.random.default_rng(6).normal(size=(120, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id bigint, x array<double>")
    sizes, kept = [], cluster.written

    def counting(d):
        out = kept(d)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cluster, "written", counting)
    monkeypatch.setattr(cluster, "STRIP", 1000)
    get = lambda d: sorted(map(tuple, d.select("sample_id", F.round("rho", 9), F.round("delta", 9), "ref", "center", "cluster", "cluster_label").collect()))
    want = get(cluster.DensityPeaks(5.0, kind).fit(df))
    assert len(want) == 120 and sizes and max(sizes) <= 120
    wide = blocks.distance_rows(blocks.samples(df), 1000)
    assert get(cluster.DensityPeaks(5.0, kind).fit_distances(wide)) == want
    if kind is None:
        long = wide.select("i", F.inline(F.arrays_zip("j", "distance")))
        assert get(cluster.DensityPeaks(5.0).fit_distances(long)) == want


def test_text_of_frames_is_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file's frames are written out by the tasks that hold them; the file is in order of id."""
    df, _ = many_frames(spark)
    whole = df.select("frame_id", F.size("atoms").alias("natoms"), "cell", "pbc", F.create_map(F.lit("task"), F.lit("x")).alias("info"), F.create_map(F.lit("k"), F.col("frame_id").cast("double")).alias("props"), F.expr("map()").cast("map<string,array<double>>").alias("desc"), F.expr("transform(atoms, a -> named_struct('idx', a.idx, 'symbol', 'H', 'z', a.z, 'pos', a.pos, 'arrays', a.arrays))").alias("atoms"))
    text = extxyz._text

    def named(f):
        from pyspark import TaskContext

        return text(f | {"info": [("task", f"t{TaskContext.get().partitionId()}")]})

    monkeypatch.setattr(extxyz, "_text", named)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    extxyz.write(whole.where("natoms > 0").repartition(4), str(tmp_path / "o"), single=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    [part] = (tmp_path / "o").glob("part-*")
    got = extxyz.read(spark, str(part)).orderBy("frame_id").collect()
    assert [r.props["k"] for r in got] == sorted(r.props["k"] for r in got) and len(got) == 45
    assert len({r.info["task"] for r in got}) > 1
