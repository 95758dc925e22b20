"""Operators against plain NumPy, round trips of readers and writers, invariances of descriptors."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from descmap import cli, hypers
from descmap.functions import kernels
from descmap.operators import blocks, cluster, density, descriptors, fit, frames, graph, reduce, sampling, series
from descmap.sources import extxyz, tables

XYZ = """3
Lattice="10 0 0 0 10 0 0 0 10" Properties=species:S:1:pos:R:3:charge:R:1 energy=-4.5 name='water one' SOAP-x="1 2 3" pbc="T T T"
O 0.0 0.0 0.1173 -0.8
H 0.0 0.7572 -0.4692 0.4
H 0.0 -0.7572 -0.4692 0.4
5
energy=-.441e-03 SOAP-x="4 5 6"
C 0 0 0
H 0.629 0.629 0.629
H -0.629 -0.629 0.629
H -0.629 0.629 -0.629
H 0.629 -0.629 -0.629
"""


@pytest.fixture(scope="module")
def xyz(tmp_path_factory):
    d = tmp_path_factory.mktemp("xyz")
    (d / "a.xyz").write_text(XYZ)
    (d / "b.xyz").write_text(XYZ)
    return d


@pytest.fixture(scope="module")
def mols(spark, xyz):
    return extxyz.read(spark, f"{xyz}/*.xyz").cache()


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(c, 0.3, (60, 3)) for c in (0, 3, 6)])
    y = x @ [1.0, -2.0, 0.5] + 0.3
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "sample_id bigint, x array<double>, y double").cache()
    return df, x, y


def table(df, col, key="sample_id"):
    return {r[key]: r[col] for r in df.collect()}


def arr(df, col, key="sample_id"):
    return np.array([v for _, v in sorted(table(df, col, key).items())])


# --- readers, writers, frames


def test_read(mols):
    got = {r.frame_id: r for r in mols.collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[k].natoms for k in range(4)] == [3, 5, 3, 5]
    a, b = got[0], got[1]
    assert a.info["name"] == "water one" and a.props == {"energy": -4.5} and a.desc == {"SOAP-x": [1, 2, 3]} and a.pbc == [True] * 3
    assert b.props == {"energy": -0.000441} and b.cell is None and b.pbc == [False] * 3
    assert [x.z for x in a.atoms] == [8, 1, 1] and a.atoms[1].arrays == {"charge": [0.4]} and b.atoms[0].symbol == "C"


def test_stride_and_periodicity(spark, xyz):
    got = extxyz.read(spark, f"{xyz}/a.xyz", stride=2, periodic=False).collect()
    assert [(r.frame_id, r.natoms, r.pbc) for r in got] == [(0, 3, [False] * 3)]


def test_write_and_read_again(spark, mols, tmp_path):
    extxyz.write(mols, str(tmp_path / "o"), single=True)
    again = {r.frame_id: r for r in extxyz.read(spark, str(tmp_path / "o" / "part-*")).collect()}
    for r in mols.collect():
        b = again[r.frame_id]
        assert (b.natoms, b.cell, b.props, b.desc, b.pbc) == (r.natoms, r.cell, r.props, r.desc, r.pbc)
        assert np.allclose([a.pos for a in b.atoms], [a.pos for a in r.atoms]) and [a.z for a in b.atoms] == [a.z for a in r.atoms]


def test_frames(spark, mols):
    c = frames.counters(mols).first()
    assert (c.nframes, c.total_natoms, c.max_atoms, c.global_species) == (4, 16, 5, [1, 6, 8])
    assert arr(frames.design_matrix(mols, ["*"]), "x").tolist() == [[1, 2, 3], [4, 5, 6]] * 2
    assert frames.resolve(["*"], ["pca-d-2", "skpca-d-2"]) == ["pca-d-2", "skpca-d-2"]
    with pytest.raises(KeyError):
        frames.design_matrix(mols, ["nothing"])
    value = lambda *a: arr(frames.property_of(mols, *a), "y").tolist()[:2]
    assert value("size") == [3, 5] and value("1") == [2, 4] and value("energy") == [-4.5, -0.000441] and value("energy", True) == [-1.5, -0.000441 / 5] and value(None) == [0, 1]
    assert abs(value("charge")[0]) < 1e-12
    made = frames.set_descriptor(mols, frames.design_matrix(mols, ["SOAP-x"]), "copy")
    assert frames.descriptor_names(made) == ["SOAP-x", "copy"] and frames.descriptor_names(frames.remove_descriptors(made, ["SOAP*", "absent"])) == ["copy"]
    rows = frames.atoms(mols).select("frame_id", "atom_idx", F.array(F.col("z").cast("double")).alias("x")).where("z = 1")
    with_z = frames.set_atomic(mols, rows, "num")
    assert frames.atomic_matrix(with_z, ["num"], 1).count() == 12
    assert {r.y for r in frames.atomic_property(mols, "energy", species=8).collect()} == {-4.5}


def test_reducers(mols):
    f = mols.where("frame_id = 0")
    assert np.allclose(frames.reduce_atoms(f, "charge", {"type": "sum"}).first().desc["charge-sum"], [0])
    assert np.allclose(frames.reduce_atoms(f, "charge", {"type": "moment_average", "zeta": 2}).first().desc["charge-z-2"], [0.96 / 3])
    assert np.allclose(frames.reduce_atoms(f, "charge", {"type": "average", "element_wise": True}, [1, 6, 8]).first().desc["charge-e"], [0.4, 0, -0.8])
    with pytest.raises(ValueError):
        frames.reduce_atoms(f, "charge", {"type": "moment_sum"} | {"zeta": None})


def test_tables(spark, mols, points, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n1 2 3\n4 5 6\n")
    m = tables.read_matrix(spark, str(tmp_path / "m.txt"))
    assert arr(m, "x").tolist() == [[1, 2, 3], [4, 5, 6]]
    assert tables.read_kernel(spark, str(tmp_path / "m.txt")).count() == 6
    tables.write_matrix(m, str(tmp_path / "w"), comment="c")
    assert arr(tables.read_matrix(spark, str(tmp_path / "w")), "x").tolist() == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "p.csv").write_text("smiles,rate\nCO,1.5\nC,\n")
    got = {r.frame_id: r for r in tables.load_properties(mols, str(tmp_path / "p.csv")).collect()}
    assert got[0].props["rate"] == 1.5 and "rate" not in got[1].props and got[1].info["smiles"] == "C" and got[2].props == {"energy": -4.5}
    df, _, _ = points
    tables.write_index(df, df.limit(3), str(tmp_path / "i"))
    assert sum(int(r.value) for r in spark.read.text(str(tmp_path / "i")).collect()) == 3
    assert tables.read_state('{"a": "[1, 2]", "b": 1}') == {"a": [1, 2], "b": 1}
    assert json.loads(json.dumps({"a": np.arange(2), "b": np.float64(1)}, cls=tables.NumbersEncoder)) == {"a": [0, 1], "b": 1.0}


def test_chemiscope(mols, tmp_path):
    tables.chemiscope(mols, str(tmp_path / "c"), cutoff=3.0)
    [part] = (tmp_path / "c").glob("part-*")
    doc = json.loads(gzip.decompress(part.read_bytes()))
    assert len(doc["structures"]) == 4 and doc["structures"][0]["names"] == ["O", "H", "H"] and len(doc["environments"]) == 16
    assert doc["properties"]["energy"]["values"][:2] == [-4.5, -0.000441] and doc["properties"]["SOAP-x[2]"]["values"] == [3, 6, 3, 6]


# --- sampling


def test_farthest_points(points, monkeypatch):
    df, x, _ = points
    want, d = [0], ((x - x[0]) ** 2).sum(1)
    for _ in range(24):
        want.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[want[-1]]) ** 2).sum(1))
    for pool in (128, 4, 1):
        monkeypatch.setattr(sampling, "POOL", pool)
        assert [i for i, _ in sampling.farthest_points(df, 25)] == want


def test_cur_rows(points):
    df, x, _ = points
    cov, want = x @ x.T, []
    for step in range(3):
        w, v = np.linalg.eig(cov)
        v = v[:, np.argsort(-np.abs(w))[: 3 - step]]
        lev = (np.abs(v) ** 2).sum(1)
        lev[want] = -1
        want.append(int(np.argmax(np.round(lev, 10))))
        u = cov[want[-1]] / np.linalg.norm(cov[want[-1]])
        cov = cov @ (np.eye(len(x)) - np.outer(u, u))
    assert sampling.cur_rows(df, 3)[0] == want[0]
    assert len(set(sampling.cur_rows(df, 3))) == 3


def test_splits(points):
    df, _, _ = points
    assert sampling.exponential_split(10, 1000, 3) == [10, 100, 1000] or sampling.exponential_split(10, 1000, 3)[1] in (99, 100)
    sizes = [r["count"] for r in sampling.k_fold(df, 7, shuffle=True).groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        sampling.sparsify(df, "fps", 1000)
    assert sampling.sparsify(df, "cur", 4).count() == 4 and sampling.sparsify(df, "sequential", 1).count() == 180
    k = df.limit(20).select(F.col("sample_id").alias("i")).crossJoin(df.limit(20).select(F.col("sample_id").alias("j"))).withColumn("k", F.lit(1.0))
    train, test = sampling.kernel_random_split(k, 0.3)
    assert math.isqrt(train.count()) ** 2 == train.count() and test.count() == (20 - math.isqrt(train.count())) * math.isqrt(train.count())


def test_numbered(points):
    df, x, _ = points
    got = graph.numbered(df.withColumn("v", F.get("x", F.lit(0))), "v", "sample_id")
    assert [i for _, i in sorted((r.number, r.sample_id) for r in got.collect())] == np.argsort(x[:, 0], kind="stable").tolist()


# --- reduction


def test_pca(points):
    df, x, _ = points
    z = (x - x.mean(0)) / x.std(0)
    w, v = np.linalg.eigh(np.cov(z.T))
    want = z @ v[:, ::-1] / np.sqrt(w[::-1])
    got = arr(reduce.PCA(3).fit(df).transform(df), "pca")
    assert np.allclose(np.abs(got), np.abs(want)) and np.allclose(got.std(0, ddof=1), 1)
    m = reduce.PCA(2).fit(df)
    with pytest.raises(RuntimeError):
        m.fit(df)


def test_kernel_pca(points):
    """With a linear kernel the projections are those of PCA, up to sign and scale of the axes."""
    df, x, _ = points
    k = x @ x.T
    got = reduce.KernelPCA(2).fit(k).apply(k)
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert np.allclose(np.abs(arr(reduce.SparseKernelPCA(2, -1).fit(df).transform(df), "skpca")), np.abs(got), atol=1e-6)
    with pytest.raises(ValueError):
        reduce.KernelPCA(2).fit(np.array([[1.0, 2], [0, 1]]))


@pytest.mark.parametrize("kind", ["UMAP", "TSNE"])
def test_layouts_keep_clusters(points, kind):
    df, x, _ = points
    made = reduce.Pipeline({"s": {"type": "SCALE"}, "m": {"type": kind, "parameter": {"n_components": 2}}}).fit_transform(df)
    y = arr(made, "reduced")
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(1) // 60 == np.arange(180) // 60).mean() > 0.98
    with pytest.raises(NotImplementedError):
        reduce.TSNE().transform(df)


# --- clustering


def test_dbscan_blocks(points, monkeypatch):
    df, x, _ = points
    whole = table(cluster.dbscan(df, 0.5, 5), "cluster_label")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5
    core = near.sum(1) >= 5
    want, n = [-1] * len(x), 0
    for s in range(len(x)):
        if core[s] and want[s] < 0:
            todo = [s]
            want[s] = n
            while todo:
                for q in np.flatnonzero(near[todo.pop()] & core):
                    if want[q] < 0:
                        want[q] = n
                        todo.append(q)
            n += 1
    for q in np.flatnonzero(~core):
        got = [want[c] for c in np.flatnonzero(near[q] & core)]
        want[q] = min(got, default=-1)
    assert [whole[k] for k in range(len(x))] == want
    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", ((), (), 50))
    assert table(cluster.dbscan(df, 0.5, 5), "cluster_label") == whole


def brute_peaks(x, percent):
    n = len(x)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    idx = np.argsort(full, axis=1, kind="stable")[:, : int(4 * percent / 100 * n)]
    dist = np.take_along_axis(full, idx, 1)
    dc, factor = dist[:, int(percent / 100 * n)].mean(), 1.0
    while True:
        dc *= factor
        dens = (dist <= dc).sum(1).astype(float)
        gap = 100 * dens.mean() / n / percent - 1
        factor = factor / 1.001 if gap > 0 else factor * 1.001
        if abs(gap) <= 0.05:
            break
    cut, far = 0.2 * dens.mean() + 0.8 * dens.min(), dist.mean()
    delta, ref = np.full(n, -100.0), np.zeros(n, int)
    for i in range(n):
        up = np.flatnonzero(dens > dens[i])
        if len(up):
            ref[i] = up[full[i, up].argmin()]
            delta[i] = full[i, ref[i]]
    delta[delta < 0] = delta.max() * 1.05
    label, k = np.zeros(n, int), -1
    for i in np.argsort(-dens, kind="stable"):
        if dens[i] > cut and delta[i] > far:
            k += 1
            label[i] = k
        else:
            label[i] = label[ref[i]]
    border = np.array([any(label[j] != label[i] for j in idx[i][dist[i] <= dc]) for i in range(n)])
    halo = label.copy()
    for c in range(k + 1):
        top = dens[border & (label == c)].max(initial=0)
        halo[(label == c) & (dens < top)] = -1
    return dc, dens, delta, label, halo


def test_density_peaks(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(c, 0.5, (70, 2)) for c in ((0, 0), (2.2, 0), (0, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id bigint, x array<double>")
    model = cluster.DensityPeaks(4.0)
    got = {q.sample_id: q for q in model.fit(df).collect()}
    dc, dens, delta, label, halo = brute_peaks(x, 4.0)
    assert abs(model.dc - dc) < 1e-9
    assert [got[i].rho for i in range(len(x))] == dens.tolist() and np.allclose([got[i].delta for i in range(len(x))], delta)
    assert [got[i].cluster for i in range(len(x))] == label.tolist() and [got[i].cluster_label for i in range(len(x))] == halo.tolist()
    s = cluster.summary(model.fit(df)).first()
    assert s.n_clusters == len(set(halo) - {-1}) and s.n_noise == (halo == -1).sum()


# --- density


@pytest.mark.parametrize("kernel", ["gaussian", "tophat", "epanechnikov", "exponential", "linear", "cosine"])
@pytest.mark.parametrize("d", [1, 2])
def test_kernels_integrate_to_one(spark, kernel, d):
    g = np.linspace(-6, 6, 241)
    at = np.stack(np.meshgrid(*[g] * d, indexing="ij"), -1).reshape(-1, d)[:: 1 if d == 1 else 1]
    t = np.sqrt((at**2).sum(1)) / 0.9
    log = density._log_kernel(kernel, t) - density.log_normaliser(kernel, 0.9, d)
    assert abs(np.exp(log).sum() * (g[1] - g[0]) ** d - 1) < 0.02


def test_bandwidth(points):
    df, x, _ = points
    m = density.BestBandwidth().fit(df)
    logs = arr(m.evaluate(), "log_density")
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.log(np.exp(-0.5 * d2 / m.bandwidth**2).mean(1)) - 1.5 * math.log(2 * math.pi) - 3 * math.log(m.bandwidth)
    assert np.allclose(logs, want) and 0.05 < m.bandwidth < 1
    assert density.round_float(0.0347) == 0.01 and density.round_float(12.3) == 1.0
    place, _, _ = density.bounded_minimum(lambda v: (v - 2) ** 2, 0, 5, 1e-4)
    assert abs(place - 2) < 1e-3


# --- regression


def test_regression(points):
    df, x, y = points
    w = np.linalg.solve(x.T @ x + 0.1 * np.eye(3), x.T @ y)
    assert np.allclose(fit.Ridge(0.1).fit(df).weights, w)
    k = (x @ x.T) ** 2
    spec = {"k": {"type": "polynomial", "d": 2}}
    full = fit.KernelRidge(0.1, spec).fit(df)
    assert np.allclose(arr(full.predict(df), "y_pred"), k @ np.linalg.solve(k + 0.1 * np.eye(180), y))
    folds = np.array_split(np.arange(180), 6)
    held = full.cross_validated(folds)
    rest = np.setdiff1d(np.arange(180), folds[2])
    assert np.allclose(held[folds[2]], k[np.ix_(folds[2], rest)] @ np.linalg.solve(k[np.ix_(rest, rest)] + 0.1 * np.eye(len(rest)), y[rest]))
    sparse = fit.SparseKernelRidge(0.01, n_sparse=20, kernel=spec).fit(df)
    knm, kmm = kernels.matrix(spec, x, sparse.x), kernels.matrix(spec, sparse.x, sparse.x)
    delta = y.std() / (np.trace(kmm) / 20)
    assert np.isclose(sparse.delta, delta)
    assert np.abs(arr(sparse.predict(df), "y_pred") - y).mean() < np.abs(y - y.mean()).mean()
    assert knm.shape == (180, 20)


def test_design_matrix(points):
    df, _, _ = points
    d = fit.DesignMatrix(df, test_ratio=0.2)
    out = d.compute_fit(fit.Ridge(1e-8))
    assert out["test"]["R2"] > 0.999 and out["train"]["SPEARMAN"] > 0.999
    curve = d.learning_curve(fit.Ridge(1e-8), points=3, repeats=2)
    assert [c["size"] for c in curve] == sorted(c["size"] for c in curve) and curve[-1]["MAE"] < 1e-3 and "R2_std" in curve[0]
    assert d.sparsify(30).count() == 30 and json.loads(d.save_state())


# --- series


def test_series(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(2, 203))
    s = spark.createDataFrame([("a", 0.5 * k, float(u), float(v)) for k, (u, v) in enumerate(zip(x, y))] + [("b", 0.0, 1.0, 1.0)], "series_id string, t double, x double, y double")
    for box in (5, 4):
        got = sorted((q.t, q.x) for q in series.smooth(s, box).where("series_id = 'a'").collect())
        assert np.allclose([v for _, v in got], np.convolve(x, np.ones(box) / box, mode="same"))
    v = sorted((q.t, q.x, q.v_x) for q in series.velocities(s).where("series_id = 'a'").collect())
    assert np.allclose([q[1] for q in v], x[1:-1] - x.mean()) and np.allclose([q[2] for q in v], x[2:] - x[:-2])
    f = {q.k: q for q in series.spectrum(s, 50).collect()}
    want = np.mean([np.fft.fft(x[k * 49 : (k + 1) * 49]) for k in range(4)], 0) * 0.5
    assert np.allclose([f[k].re + 1j * f[k].im for k in range(49)], want)
    back = sorted((q.k, q.re) for q in series.inverse(series.spectrum(s, 203)).collect())
    assert np.allclose([q[1] for q in back], 0.5 * x)
    d = {q.k: q for q in series.derivative(series.spectrum(s, 50)).collect()}
    assert np.isclose(d[3].re, -f[3].omega * f[3].im) and np.isclose(d[3].im, f[3].omega * f[3].re)


# --- descriptors


def frame(z, pos, cell=None):
    return descriptors.Frame(np.array(z), np.array(pos, float), None if cell is None else np.array(cell, float), np.array([cell is not None] * 3))


SPECS = [(descriptors.soap, {"species": [1, 8], "cutoff": 3.0, "n": 3, "l": 3, "sigma": 0.4}), (descriptors.soap, {"species": [1, 8], "cutoff": 3.0, "n": 3, "l": 2, "sigma": 0.4, "rbf": "polynomial", "crossover": True}), (descriptors.acsf, {"species": [1, 8], "cutoff": 4.0, "g2_params": [[1, 0.5]], "g3_params": [1.0], "g4_params": [[0.1, 2, -1]], "g5_params": [[0.1, 1, 1]]}), (descriptors.lmbtr_k2, {"species": [1, 8], "grid": {"n": 12}}), (descriptors.lmbtr_k3, {"species": [1, 8], "grid": {"n": 12}})]


@pytest.mark.parametrize("fn,spec", SPECS)
def test_descriptors_are_invariant(fn, spec):
    z, pos = [8, 1, 1, 8], np.array([[0, 0, 0], [0.9, 0.1, 0], [-0.2, 0.9, 0.3], [1.5, 1.2, -0.8]])
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    a, b = fn(frame(z, pos), spec), fn(frame(z, pos @ q.T + 5), spec)
    assert np.abs(a).max() > 1e-3 and np.allclose(a, b, rtol=1e-5, atol=1e-8 * np.abs(a).max())
    order = [3, 1, 0, 2]
    assert np.allclose(fn(frame(np.array(z)[order], pos[order]), spec), a[order])
    cell = np.eye(3) * 4.0
    one = fn(frame(z, pos, cell), spec)
    two = fn(frame(z * 2, np.vstack([pos, pos + [4, 0, 0]]), np.diag([8.0, 4, 4])), spec)
    assert np.allclose(two[:4], one, rtol=1e-6, atol=1e-9 * np.abs(one).max()) and not np.allclose(one, a)


def test_soap_length():
    assert descriptors.soap(frame([1, 6, 7, 8], np.eye(4, 3)), {"cutoff": 1.9, "n": 4, "l": 3, "sigma": 0.23}).shape == (4, 160)


def test_coulomb():
    m = descriptors.coulomb(frame([1, 8], [[0, 0, 0], [0, 0, 2]]), {"max_atoms": 3}).reshape(3, 3)
    assert np.allclose(m, [[0.5 * 8**2.4, 4, 0], [4, 0.5, 0], [0, 0, 0]])
    with pytest.raises(ValueError):
        descriptors.coulomb(frame([1, 1], np.eye(2, 3)), {"max_atoms": 1})


def test_compute(mols):
    spec = {"cm": {"type": "CM", "max_atoms": 5}, "s": {"atomic_descriptor": {"a": {"type": "ACSF", "cutoff": 3.0, "g2_params": [[1.0, 0.0]]}}, "reducer_function": {"r1": {"type": "average"}, "r2": {"type": "sum", "element_wise": True}}}}
    free = mols.where("frame_id % 2 = 1")
    got = descriptors.compute_global(free, spec).first()
    assert set(got.desc) == {"SOAP-x", "CM-5", "ACSF-c3.0-g2-1", "ACSF-c3.0-g2-1-sum-e"} and len(got.desc["CM-5"]) == 25 and "charge" not in got.atoms[0].arrays
    descriptors.register_global("COUNT", lambda f, s: np.array([float(len(f.z))]))
    assert descriptors.compute_global(mols, {"n": {"type": "COUNT"}}).first().desc["COUNT"] == [3.0]
    with pytest.raises(NotImplementedError):
        descriptors.acronym({"type": "FCHL19"})


def test_hypers():
    s = hypers.soap([1, 6, 8], "smart")
    assert list(s) == ["soap1", "soap2"] and s["soap1"]["cutoff"] == hypers.significant(max(1.2 * 2.0, 1.3 * 1.2 * 1.7), 2) and s["soap2"]["cutoff"] == 2.0
    assert len(hypers.soap([1, 6], sets=3)) == 2 and len(hypers.soap([1, 6], "minimal")) == 1
    a = next(iter(hypers.acsf([1, 8]).values()))
    assert a["cutoff"] == 2.2 and all(len(p) == 2 for p in a["g2_params"]) and {p[1] for p in a["g4_params"]} <= {1.0, 4.0, 16.0}
    with pytest.raises(KeyError):
        hypers.soap([118])


# --- command line


def test_cli(spark, xyz, points, tmp_path):
    run = lambda *a: cli.main([*a, "--prefix", str(tmp_path / "o")], spark)
    assert run("gen_desc", "soap", "--fxyz", f"{xyz}/a.xyz", "--cutoff", "3", "--nmax", "2", "--lmax", "2").count() == 2
    assert frames.descriptor_names(extxyz.read(spark, str(tmp_path / "o.xyz" / "part-*"))) == ["SOAP-n2-l2-c3.0-g0.5", "SOAP-x"]
    df, _, _ = points
    tables.write_matrix(df, str(tmp_path / "m"))
    (tmp_path / "y.txt").write_text("\n".join(str(r.y) for r in df.orderBy("sample_id").collect()))
    m = ("--matrix", str(tmp_path / "m"))
    assert run("select", *m, "--algorithm", "fps", "--nkeep", "7").count() == 7
    assert run("map", "pca", *m, "--dimension", "2", "--scale").count() == 180
    assert run("cluster", "dbscan", *m, "--eps", "0.6").select("cluster_label").distinct().count() >= 3
    assert run("kde", "sklearn", *m, "--bandwidth", "0.5").count() == 180
    assert run("fit", "ridge", *m, "--y", str(tmp_path / "y.txt"), "--test-ratio", "0.2")["fit"]["test"]["R2"] > 0.99


def test_cli_atoms_colours_kernels(spark, xyz, points, tmp_path):
    """Samples that are atoms, atoms projected with their frames, points with colours and tags, kernel files, states."""
    out = str(tmp_path / "o")
    run = lambda *a: cli.main([*a, "--prefix", out], spark)
    soap = ("--cutoff", "3", "--nmax", "2", "--lmax", "2")
    run("gen_desc", "soap", "--fxyz", f"{xyz}/*.xyz", *soap)
    spark.read.text(f"{out}.xyz").coalesce(1).write.text(str(tmp_path / "frames"))
    run("gen_desc", "soap", "--fxyz", str(tmp_path / "frames" / "part-*"), *soap, "--peratom")
    state = tables.read_state(spark.read.text(f"{out}-state.json", wholetext=True).first().value)
    assert list(state["acronyms"].values()) == ["SOAP-n2-l2-c3.0-g0.5"]
    spark.read.text(f"{out}.xyz").coalesce(1).write.text(str(tmp_path / "both"))
    both = str(tmp_path / "both" / "part-*")
    dm = ("--dm", "SOAP-n2-l2-c3.0-g0.5")
    (tmp_path / "tags.txt").write_text("\n".join(f"tag{k}" for k in range(16)))
    atoms = run("map", "pca", "--fxyz", both, *dm, "--use-atomic", "--species", "1", "--dimension", "2", "--output", "matrix", "--color", "energy", "--annotate", str(tmp_path / "tags.txt"))
    assert atoms.count() == 12
    points_ = spark.read.csv(f"{out}-points", header=True, inferSchema=True).collect()
    assert len(points_) == 12 and {round(p.colour, 6) for p in points_} == {-4.5, -0.000441} and {p.tag for p in points_} == {f"tag{k}" for k in range(12)}
    assert spark.read.text(f"{out}.atomic-coord").where("value not like '#%'").count() == 12
    run("map", "pca", "--fxyz", both, *dm, "--peratom", "--dimension", "2", "--output", "xyz")
    got = extxyz.read(spark, f"{out}.xyz/part-*")
    assert got.count() == 4 and frames.atoms(got).select(F.size(F.col("arrays")["pca-d-2"]).alias("n")).distinct().collect()[0].n == 2
    # the kernel of three groups of points
    _, x, _ = points
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 20)
    np.savetxt(tmp_path / "k.txt", k)
    labels = run("cluster", "dbscan", "--kernel-matrix", str(tmp_path / "k.txt"), "--eps", "2.0")
    assert labels.where("cluster_label >= 0").select("cluster_label").distinct().count() == 3
    (tmp_path / "plain.xyz").write_text("2\nany = text here\nO 0 0 0\nH 0 0 1\n\n1\n\nC 1 1 1\n")
    plain = extxyz.read(spark, str(tmp_path / "plain.xyz"), kind="xyz").orderBy("frame_id").collect()
    assert [(p.natoms, p.info["comment"]) for p in plain] == [(2, "any = text here"), (1, "")]
    with pytest.raises(ValueError):
        extxyz.read(spark, str(tmp_path / "plain.xyz"), kind="cif")
    assert extxyz.count(XYZ) == 2 == extxyz.count(XYZ + "\n\n") and extxyz.count(XYZ * 3, 4) == 2


def test_within_reach(spark, points, monkeypatch):
    """Blocks by ranges of a projection: the same counts, clusters and densities as with all blocks, and fewer of them."""
    df, x, _ = points
    same = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(1000, 1080)], "sample_id bigint, x array<double>")  # one point, many rows
    both = df.select("sample_id", "x").unionByName(same)
    all_blocks = [cluster.dbscan(both, 0.6), density.kde(both, 0.8, "linear")]
    want = [sorted(map(tuple, d.collect())) for d in all_blocks]
    rows = blocks.samples(both)
    seen = blocks.pair_blocks(rows, rows, lambda a, b: blocks.pa.table({"n": [len(a.ids) * len(b.ids)]}), "n bigint", rows=16, reach=0.6).agg(F.sum("n")).first()[0]
    assert seen < 0.7 * 260**2
    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", ((), (), 16))
    counts = {r.id: r.n for r in cluster.neighbour_counts(rows, 0.6).collect()}
    v = np.array([r.x for r in rows.orderBy("id").collect()])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    assert [n for _, n in sorted(counts.items())] == (d <= 0.6).sum(1).tolist()
    got = [sorted(map(tuple, d.collect())) for d in (cluster.dbscan(both, 0.6), density.kde(both, 0.8, "linear"))]
    assert got[0] == want[0]
    assert [i for i, _ in got[1]] == [i for i, _ in want[1]] and np.allclose([v for _, v in got[1]], [v for _, v in want[1]])


def test_quantiles(spark):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=501), 1)
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "v double").repartition(5)
    got = graph.quantiles(df, "v", [0.0, 0.05, 0.333, 0.5, 1.0])
    assert np.allclose(got, np.quantile(v, [0.0, 0.05, 0.333, 0.5, 1.0]))
    assert graph.quantiles(df.limit(0), "v", [0.5]) is None


def test_solver_after_fork(spark):
    """The driver has forked by now; solvers of more than a hundred rows must return."""
    a = np.eye(300) * 50 + np.random.default_rng(0).random((300, 300))
    assert np.allclose(np.linalg.inv(a) @ a, np.eye(300))


def test_landmark_limit(spark, points, monkeypatch):
    monkeypatch.setattr(sampling, "LANDMARKS", 20)
    with pytest.raises(ValueError):
        sampling.landmarks(points[0], n=30)
    assert sampling.sparsify(points[0], "fps", 30).count() == 30
