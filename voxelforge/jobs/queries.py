"""One query per inventory operator on the fixed views, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import kernels as K
from ..functions.shared import shared_folder
from ..operators import arrange as R
from ..operators import calib as C
from ..operators import elementwise as E
from ..operators import joins as J
from ..operators import coupled as CC
from ..operators import lines as L
from ..operators import noncartesian as N
from ..operators import positions as P
from ..operators import recon as B
from ..operators import reduce as A
from ..operators import terms as TT
from ..operators import transforms as T
from ..operators import windows as W
from ..sources import bundle, cfl, slabs
from ..streaming import frames as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS = {
    "img": "img AS (SELECT vec_id, label, (i//8)::INT AS y, (i%8)::INT AS x, embedding[i+1]::DOUBLE AS re, 0.0::DOUBLE AS im FROM embeddings, range(64) t(i))",
    "coils": "coils AS (SELECT vec_id, i::INT AS c, embedding[i+1]::DOUBLE AS re, embedding[i+33]::DOUBLE AS im FROM embeddings, range(32) t(i))",
    "kspace": "kspace AS (SELECT vec_id, label, (i//16)::INT AS coil, ((i%16)//4)::INT AS y, (i%4)::INT AS x, embedding[i+1]::DOUBLE AS re, embedding[i+33]::DOUBLE AS im FROM embeddings, range(32) t(i))",
    "signal": "signal AS (SELECT user_id AS ch, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1)::INT AS i, value AS re, 0.0::DOUBLE AS im FROM events)",
    "sparse": "sparse AS (SELECT l_suppkey AS coil, l_partkey AS k, l_quantity AS re, l_discount AS im FROM lineitem)",
    "echo": "echo AS (SELECT p_partkey, e::INT AS e, 12.5::DOUBLE*e AS te, p_retailprice*exp(-12.5::DOUBLE*e/(20+p_size)) AS re, 0.0::DOUBLE AS im FROM part, range(1,9) t(e))",
}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register a query; ``sql`` follows the named views, and ``[x]`` in it rounds x like the query does."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            text = sql
            while "[[" in text:  # [[x]] -> rounded x
                a = text.rindex("[[")
                b = text.index("]]", a)
                text = f"{text[:a]}(round(({text[a + 2 : b]})::DOUBLE, 6) + 0.0::DOUBLE){text[b + 2 :]}"
            named = [VIEWS[v] for v in views] + ([text[1:]] if text.startswith("+") else [])  # "+": further views come first
            ORACLES[name] = ("WITH " + ", ".join(named) if named else "") + ("" if text.startswith("+") else " " + text)
        return f

    return add


def out(df: DataFrame, *keys: str, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    return df.select(*keys, *(M.rounded(v).alias(v) for v in values))


CO, IM = ("vec_id", "c"), ("vec_id", "y", "x")


def cells(name: str, view: Callable, keys: tuple[str, ...], fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query that maps one view cell by cell; ``sql`` gives re and im."""
    query(name, None if sql is None else f"SELECT {', '.join(keys)}, {sql} FROM {view.__name__}", view.__name__)(lambda s, d: out(fn(view(s, d)), *keys))


# sources, sinks, layout


def _written(s: SparkSession, d: str) -> str:
    folder = f"{shared_folder(s)}/arrays-{uuid.uuid4().hex}"
    names = cfl.write(M.tile(s, d).withColumn("array_id", F.concat(F.lit("a"), "vec_id")), folder)
    names.write.format("noop").mode("overwrite").save()
    return folder


@query("s1_readcfl", "SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM img", "img")
def s1(s, d):
    tiles = cfl.read(s, _written(s, d)).withColumn("vec_id", F.substring("array_id", 2, 20).cast("long")).drop("array_id")
    return out(M.tiles_to_cells(tiles, ["y", "x"], [8, 8]), *IM)


def _ragged(s: SparkSession, d: str) -> DataFrame:
    """One array (i, y, x) per label, as slabs of one image each."""
    e = M.table(s, d, "embeddings").select("label", "vec_id", "embedding")
    n = e.groupBy("label").agg(F.count("*").cast("int").alias("n"))
    first = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long") * 64
    re = F.transform("embedding", lambda v: v.cast("float"))
    return e.withColumn("start", first).join(n, "label").select(F.concat(F.lit("l"), "label").alias("array_id"), F.array("n", F.lit(8), F.lit(8)).alias("shape"), "start", re.alias("re"), F.transform(re, lambda v: -v).alias("im"))


@query("s1_ranges", "SELECT label::INT AS label, (row_number() OVER (PARTITION BY label, y, x ORDER BY vec_id)-1)::INT AS i, y, x, [[re]] AS re, [[-re]] AS im FROM img", "img")
def s1_ranges(s, d):
    """Ragged arrays written in slabs of images and read in ranges that ignore the images."""
    folder = f"{shared_folder(s)}/slabs-{uuid.uuid4().hex}"
    slabs.write_slabs(_ragged(s, d), folder).write.format("noop").mode("overwrite").save()
    got = slabs.slabs_to_cells(slabs.read_slabs(s, folder, 8 * 1000, 300), ["i", "y", "x"])
    return out(got.withColumn("label", F.substring("array_id", 2, 20).cast("int")), "label", "i", "y", "x")


@query("s2_slabs", "SELECT 'l' || label AS array_id, (512*count(*))::BIGINT AS bytes FROM embeddings GROUP BY label")
def s2_slabs(s, d):
    return slabs.write_slabs(_ragged(s, d), f"{shared_folder(s)}/slabs-{uuid.uuid4().hex}")


@query("s2_writecfl", "SELECT 'a' || vec_id AS array_id, 512::BIGINT AS bytes FROM embeddings")
def s2(s, d):
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.cfl").load(_written(s, d))
    return files.select(F.regexp_extract("path", r"([^/]+)\.cfl$", 1).alias("array_id"), F.col("length").alias("bytes"))


@query("s3_multicfl", "SELECT vec_id, label, len(embedding)::INT AS n FROM embeddings")
def s3(s, d):
    folder = f"{shared_folder(s)}/bundle-{uuid.uuid4().hex}"
    bundle.write_bundle(M.tile(s, d), folder, "label")
    return bundle.read_bundle(s, folder, "label").select("vec_id", "label", F.size("re").alias("n"))


@query("s4_toraw", "SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM img", "img")
def s4(s, d):
    folder = f"{shared_folder(s)}/raw-{uuid.uuid4().hex}"
    cfl.write_raw(M.tile(s, d).withColumn("array_id", F.concat(F.lit("a"), "vec_id")), folder).write.format("noop").mode("overwrite").save()
    back = cfl.read_raw(s, folder).withColumn("vec_id", F.substring("array_id", 2, 20).cast("long")).drop("array_id")
    return out(M.tiles_to_cells(back, ["y", "x"], [8, 8]), *IM)


@query("s5_toimg", "+m AS (SELECT vec_id, max(abs(re)) AS m FROM img GROUP BY 1) SELECT vec_id, y, x, CASE WHEN m=0 THEN 0 ELSE least(255, floor(255*abs(re)/(0.75*m))) END::INT AS grey FROM img JOIN m USING (vec_id)", "img")
def s5(s, d):
    return bundle.grey(M.img(s, d), ["vec_id"]).select(*IM, "grey")


@query("s6_reshape", "SELECT vec_id, ((y*8+x)//16)::INT AS a, ((y*8+x)%16)::INT AS b, [[re]] AS re, [[im]] AS im FROM img", "img")
def s6(s, d):
    t = M.cells_to_tiles(M.img(s, d), ["vec_id"], ["y", "x"], [8, 8])
    return out(M.tiles_to_cells(t, ["a", "b"], [4, 16]), "vec_id", "a", "b")


@query("s7_channels", "SELECT vec_id, c, part, [[v]] AS v FROM (SELECT vec_id, c, 0 AS part, re AS v FROM coils UNION ALL SELECT vec_id, c, 1, im FROM coils)", "coils")
def s7(s, d):
    back = bundle.as_complex(bundle.as_channels(M.coils(s, d)))
    return bundle.as_channels(back).select(*CO, "part", M.rounded("v").alias("v"))


# generators: applied to the axes of a table, so that they grow with it
@query("g1_index", "SELECT i::INT AS i, log, [[CASE WHEN log THEN exp(ln(2.0)+i/15.0*ln(8.0)) ELSE -1.0+i/15.0*3.0 END]] AS re, 0.0::DOUBLE AS im FROM range(16) t(i), (SELECT DISTINCT label%2=1 AS log FROM embeddings)")
def g1(s, d):
    logs = M.table(s, d, "embeddings").select((F.col("label") % 2 == 1).alias("log")).distinct()
    both = R.index(s, 16, -1.0, 2.0).withColumn("log", F.lit(False)).unionByName(R.index(s, 16, 2.0, 16.0, log=True).withColumn("log", F.lit(True)))
    return out(both.join(logs, "log"), "i", "log")


cells("g2_delta", M.img, IM, lambda x: R.delta(x, ["y", "x"]), "(y=x)::INT::DOUBLE AS re, 0.0::DOUBLE AS im")


@query("g2_constants", "SELECT vec_id, y, x, [[3*re + (y+1)*(x+2)]] AS re, [[3*im]] AS im FROM img", "img")
def g2(s, d):
    ones, zeros = R.ones(s, {"y": 8, "x": 8}), R.zeros(s, {"y": 8, "x": 8})
    line = lambda axis, first: R.vector(s, [float(first + i) for i in range(8)], axis)
    product = J.fmac(J.fmac(ones, line("y", 1), ["y"], ["y", "x"]), line("x", 2), ["x"], ["y", "x"])
    spread = M.cells_to_tiles(R.add_parts([product, zeros], ["y", "x"]).withColumn("all", F.lit(0)), ["all"], ["y", "x"], [8, 8])
    return out(M.tiles_to_cells(R.add_to_tiles(M.tile(s, d), spread.drop("all"), 3.0), ["y", "x"], [8, 8]), *IM)


@query("g3_grid", "SELECT vec_id, y, x, [[(y-4)/8.0::DOUBLE]] AS py, [[(x-4)/8.0::DOUBLE]] AS px, [[0.5+label*0.25]] AS plabel FROM img", "img")
def g3(s, d):
    return out(R.grid(M.img(s, d), {"y": 8, "x": 8}, time=("label", 0.5, 0.25)), *IM, values=("py", "px", "plabel"))


@query("g5_traj_options", "SELECT p_partkey, q::INT AS sample, false AS line, [[(q-8.0::DOUBLE+0.5)/2*cos(p_partkey*2*pi()/13)]] AS kx, [[(q-8.0::DOUBLE+0.5)/2*sin(p_partkey*2*pi()/13)]] AS ky FROM part, range(16) t(q) UNION ALL SELECT p_partkey, q::INT, true, q-8.0::DOUBLE, p_partkey-100.0::DOUBLE FROM part, range(16) t(q)")
def g5_more(s, d):
    p = M.table(s, d, "part").select("p_partkey")
    spokes = R.radial(p, "p_partkey", 13, 16, full_circle=True, oversampling=2.0, half_sample=True).withColumn("line", F.lit(False))
    return out(spokes.unionByName(R.cartesian(p, "p_partkey", 200, 16).withColumn("line", F.lit(True))), "p_partkey", "sample", "line", values=("kx", "ky"))


cells("g4_poly", M.signal, ("ch", "i"), lambda x: R.polynomial(x, "i", [1.0, -2.0, 0.5]), "[[1 - 2.0*i + 0.5*i*i]] AS re, 0.0::DOUBLE AS im")


@query("g5_traj", "SELECT p_partkey, q::INT AS sample, [[(q-8.0::DOUBLE)*cos(p_partkey*pi()*(sqrt(5)-1)/2)]] AS kx, [[(q-8.0::DOUBLE)*sin(p_partkey*pi()*(sqrt(5)-1)/2)]] AS ky FROM part, range(16) t(q)")
def g5(s, d):
    return out(R.radial(M.table(s, d, "part").select("p_partkey"), "p_partkey", 1, 16, golden=True), "p_partkey", "sample", values=("kx", "ky"))


@query("g6_upat", "SELECT vec_id, y, x FROM img WHERE (y%2=0 AND x%2=0) OR (y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4)", "img")
def g6(s, d):
    return R.undersample(M.img(s, d), ("y", 8, 2), ("x", 8, 2), 2).select(*IM)


@query("g7_pattern", "SELECT k, max((re<>0 OR im<>0)::INT)::DOUBLE AS re, 0.0::DOUBLE AS im FROM sparse GROUP BY k", "sparse")
def g7(s, d):
    return R.sampled(M.sparse(s, d), ["k"])


@query("g8_estdims", "SELECT ch, (2*ceil(max(abs(re))))::BIGINT AS n FROM signal GROUP BY ch", "signal")
def g8(s, d):
    return M.signal(s, d).groupBy("ch").agg((2 * F.ceil(F.max(F.abs("re")))).cast("long").alias("n"))


@query("g9_onehot", "SELECT vec_id, c::INT AS cls, (label=c)::INT::DOUBLE AS re FROM embeddings, range(10) t(c)")
def g9(s, d):
    return R.one_hot(M.table(s, d, "embeddings"), "label", 10).select("vec_id", "cls", "re")


@query("g10_noise", "SELECT 0.0::DOUBLE AS mean, 2.0::DOUBLE AS var, count(*)*32 AS n FROM embeddings")
def g10(s, d):
    x = M.coils(s, d)
    noisy = R.add_noise(x.withColumnsRenamed({"re": "r", "im": "i"}).withColumns({"re": F.col("r"), "im": F.col("i")}), 2.0, 11)
    e = noisy.select((F.col("re") - F.col("r")).alias("a"), (F.col("im") - F.col("i")).alias("b"))
    return e.agg(M.rounded(F.avg(F.col("a") + F.col("b")), 1).alias("mean"), M.rounded(F.var_samp("a") + F.var_samp("b"), 1).alias("var"), F.count("*").alias("n"))


# element-wise
cells("e1_abs_arg", M.coils, CO, lambda x: E.conj(x).withColumns({"re": E.modulus(), "im": -F.atan2("im", "re")}), "[[sqrt(re*re+im*im)]] AS re, [[atan2(im,re)]] AS im")


@query("e2_saxpy", "+y AS (SELECT vec_id, c, re*0.6-im*0.8 AS re, re*0.8+im*0.6 AS im FROM coils WHERE c<>3) SELECT vec_id, c, [[2*a.re+coalesce(y.re,0)]] AS re, [[2*a.im+coalesce(y.im,0)]] AS im FROM coils a LEFT JOIN y USING (vec_id,c)", "coils")
def e2(s, d):
    x = M.coils(s, d)
    return out(E.axpy(2.0, x, E.scale(x, 0.6, 0.8).where("c <> 3"), CO), *CO)


cells("e3_power", M.coils, CO, lambda x: E.exponential(E.power(x, 1.5), imaginary=True), "[[exp(-pow(sqrt(re*re+im*im),1.5)*sin(1.5*atan2(im,re)))*cos(pow(sqrt(re*re+im*im),1.5)*cos(1.5*atan2(im,re)))]] AS re, [[exp(-pow(sqrt(re*re+im*im),1.5)*sin(1.5*atan2(im,re)))*sin(pow(sqrt(re*re+im*im),1.5)*cos(1.5*atan2(im,re)))]] AS im")
cells("e4_invert", M.sparse, ("coil", "k"), E.invert, "[[CASE WHEN re*re+im*im=0 THEN 0 ELSE re/(re*re+im*im) END]] AS re, [[CASE WHEN re*re+im*im=0 THEN 0 ELSE -im/(re*re+im*im) END]] AS im")


@query("e5_cpyphs", "+s AS (SELECT vec_id, c, re/sqrt(re*re+im*im) AS r, im/sqrt(re*re+im*im) AS i FROM coils WHERE re<>0 OR im<>0) SELECT vec_id, c, [[sqrt(re*re+0.01)*r]] AS re, [[sqrt(re*re+0.01)*i]] AS im FROM coils JOIN s USING (vec_id,c)", "coils")
def e5(s, d):
    x = M.coils(s, d)
    return out(E.copy_phase(E.smooth_abs(E.real(x), 0.01), x, CO), *CO)


cells("e6_component_diagonal", M.coils, CO, lambda x: E.component_diagonal(x, 2.0, 0.5), "[[2*re]] AS re, [[im*0.5]] AS im")


@query("e7_soft_thresh", "+m AS (SELECT vec_id, sqrt(sum(re*re+im*im)) AS m FROM coils GROUP BY 1) SELECT vec_id, c, [[CASE WHEN m=0 THEN 0 ELSE re*greatest(1-0.5/m,0) END]] AS re, [[CASE WHEN m=0 THEN 0 ELSE im*greatest(1-0.5/m,0) END]] AS im FROM coils JOIN m USING (vec_id)", "coils")
def e7(s, d):
    return out(E.soft_threshold(M.coils(s, d), 0.5, ["vec_id"]), *CO)


@query("e8_hard_thresh", "SELECT vec_id, c, [[re]] AS re, [[im]] AS im FROM coils WHERE sqrt(re*re+im*im) > 0.2", "coils")
def e8(s, d):
    return out(E.hard_threshold(M.coils(s, d), 0.2), *CO)


cells("e9_non_negative", M.coils, CO, E.non_negative, "[[greatest(re,0)]] AS re, [[greatest(im,0)]] AS im")
cells("e10_prox", M.coils, CO, lambda x: E.prox_imaginary_l1(E.prox_l2(x, 0.25), 0.05), "[[re/1.25]] AS re, [[sign(im)*greatest(abs(im/1.25)-0.05,0)]] AS im")
cells("e11_window", M.img, IM, lambda x: E.window(x, {"y": 8, "x": 8}), "[[re*(0.54-0.46*cos(2*pi()*y/7))*(0.54-0.46*cos(2*pi()*x/7))]] AS re, 0.0::DOUBLE AS im")
cells("e12_fftmod", M.img, IM, lambda x: E.fft_modulation(x, {"y": 8, "x": 8}), "[[re*cos(2*pi()*4*(y-2.0)/8+2*pi()*4*(x-2.0)/8)]] AS re, [[re*sin(2*pi()*4*(y-2.0)/8+2*pi()*4*(x-2.0)/8)]] AS im")
cells("e13_fovshift", M.img, IM, lambda x: E.fov_shift(x, {"y": (8, 0.1), "x": (8, -0.3)}), "[[re*cos(2*pi()*((y-4)*0.1-(x-4)*0.3))]] AS re, [[re*sin(2*pi()*((y-4)*0.1-(x-4)*0.3))]] AS im")
cells("e3_logarithm", M.coils, CO, E.logarithm, "[[ln(sqrt(re*re+im*im))]] AS re, [[atan2(im,re)]] AS im")
cells("e8_binary", M.coils, CO, lambda x: E.binary_threshold(x, 0.2), "(sqrt(re*re+im*im)>0.2)::INT::DOUBLE AS re, 0.0::DOUBLE AS im")


@query("e13_fovshift_trajectory", "+p AS (SELECT p_partkey%7-3.0::DOUBLE AS kx, p_partkey AS k FROM part) SELECT coil, k, [[re*cos(2*pi()*kx*0.3)-im*sin(2*pi()*kx*0.3)]] AS re, [[re*sin(2*pi()*kx*0.3)+im*cos(2*pi()*kx*0.3)]] AS im FROM sparse JOIN p USING (k)", "sparse")
def e13(s, d):
    p = M.table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7 - 3.0).alias("kx"))
    return out(E.fov_shift_along(M.sparse(s, d), p, ["k"], {"kx": 0.3}), "coil", "k")


cells("e14_calc", M.coils, CO, lambda x: E.calc(x, "re * re - im * im", "2 * re * im + c"), "[[re*re-im*im]] AS re, [[2*re*im+c]] AS im")

# rearranging


def moved(name: str, fn: Callable, sql: str, keys: tuple[str, ...] = IM) -> None:
    query(name, f"SELECT {sql}, [[re]] AS re, [[im]] AS im FROM img", "img")(lambda s, d: out(fn(M.img(s, d)), *keys))


query("r1_slice", "SELECT vec_id, y-2 AS y, x-1 AS x, [[re]] AS re, [[im]] AS im FROM img WHERE y>=2 AND y<6 AND x>=1 AND x<7", "img")(lambda s, d: out(R.extract(M.img(s, d), {"y": (2, 6), "x": (1, 7)}), *IM))
query("r2_resize", "SELECT vec_id, y-2 AS y, x+1 AS x, [[re]] AS re, [[im]] AS im FROM img WHERE y>=2 AND y<7", "img")(lambda s, d: out(R.resize(M.img(s, d), {"y": (8, 5), "x": (8, 10)}), *IM))
query("r3_pad", "SELECT vec_id, t::INT AS y, x, [[re]] AS re, [[im]] AS im FROM range(13) r(t) JOIN img ON y = CASE WHEN ((t-2)%14+14)%14 < 8 THEN ((t-2)%14+14)%14 ELSE 14-((t-2)%14+14)%14 END", "img")(lambda s, d: out(R.pad(M.img(s, d), "y", 8, 2, 3, "reflect"), *IM))
moved("r4_flip", lambda x: R.flip(x, {"y": 8}), "vec_id, 7-y AS y, x")
moved("r5_circshift", lambda x: R.fft_shift(R.roll(x, "y", 8, 3), {"x": 8}), "vec_id, (y+3)%8 AS y, (x+4)%8 AS x")
moved("r6_transpose", lambda x: R.transpose(x, "y", "x"), "vec_id, x AS y, y AS x")
query("r7_repmat", "SELECT vec_id, y, x, t::INT AS t, [[re]] AS re, [[im]] AS im FROM img, range(3) r(t)", "img")(lambda s, d: out(R.repeat(M.img(s, d), "t", 3), *IM, "t"))


@query("r8_join", "SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM img UNION ALL SELECT vec_id, y+8, x, [[2*re]], [[2*im]] FROM img", "img")
def r8(s, d):
    x = M.img(s, d)
    return out(R.concatenate([(x, 8), (E.scale(x, 2.0), 8)], "y"), *IM)


@query("r9_block_diag", "SELECT vec_id, x, [[sum(CASE WHEN y<4 THEN re ELSE -re END)]] AS re, [[sum(im)]] AS im FROM img GROUP BY vec_id, x", "img")
def r9(s, d):
    x = M.img(s, d)
    return out(R.add_parts([x.where("y < 4"), E.scale(x.where("y >= 4"), -1.0)], ["vec_id", "x"]), "vec_id", "x")


@query("r9_block_matrix", "SELECT vec_id, y, x, [[sum(v)]] AS re, 0.0::DOUBLE AS im FROM (SELECT vec_id, y, x, CASE WHEN y<4 THEN 2*re END AS v FROM img WHERE y<4 UNION ALL SELECT vec_id, y-4, x, re FROM img WHERE y>=4 UNION ALL SELECT vec_id, y, x, -re FROM img WHERE y>=4) GROUP BY 1,2,3", "img")
def r9_matrix(s, d):
    x = M.img(s, d).drop("label")
    top, low = x.where("y < 4"), R.extract(x, {"y": (4, 8)})
    rows = [([lambda t: E.scale(t, 2.0), lambda t: t], 4), ([None, lambda t: E.scale(t, -1.0)], 4)]
    return out(R.block_matrix(rows, [top, low], IM, "y"), *IM)


@query("r10_copy", "SELECT vec_id, y, x, [[CASE WHEN y BETWEEN 1 AND 2 AND x>=3 THEN -re ELSE re END]] AS re, [[im]] AS im FROM img", "img")
def r10(s, d):
    x = M.img(s, d)
    return out(R.overlay(x, E.scale(x.where("y BETWEEN 1 AND 2 AND x >= 3"), -1.0), IM), *IM)


@query("r11_compress", "SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM img JOIN (SELECT vec_id, i::INT AS x FROM embeddings, range(8) t(i) WHERE embedding[i+1]>0) m USING (vec_id, x)", "img")
def r11(s, d):
    x = M.img(s, d)
    mask = x.where("y = 0").select("vec_id", "x", (F.col("re") > 0).cast("double").alias("re"))
    return out(R.compress(x, mask, ["vec_id", "x"]), *IM)


@query("r11_expand", "+m AS (SELECT vec_id, i::INT AS x FROM embeddings, range(8) t(i) WHERE embedding[i+1]>0) SELECT m.vec_id, y, m.x, [[CASE WHEN re>-0.1 THEN re ELSE 0 END]] AS re, 0.0::DOUBLE AS im FROM img JOIN m ON m.vec_id=img.vec_id AND m.x=img.x", "img")
def r11_expand(s, d):
    x = M.img(s, d).drop("label")
    line = x.where("y = 0 AND re > 0").select("vec_id", "x")
    mask = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), F.lit(1.0).alias("re"))
    return out(R.expand(x.where("re > -0.1"), mask, IM), *IM)


# joins


@query("j1_fmac", "+b AS (SELECT label, y, x, sum(re) AS br, count(*)*0.1::DOUBLE AS bi FROM img GROUP BY 1,2,3) SELECT vec_id, y, [[sum(re*br+im*bi)]] AS re, [[sum(im*br-re*bi)]] AS im FROM img JOIN b USING (label,y,x) GROUP BY 1,2", "img")
def j1(s, d):
    x = M.img(s, d)
    b = x.groupBy("label", "y", "x").agg(F.sum("re").alias("re"), (F.count("*") * 0.1).alias("im"))
    return out(J.fmac(x, b, ["label", "y", "x"], ["vec_id", "y"], conjugate=True), "vec_id", "y")


@query("j2_sampling", "SELECT coil, k, [[re*s_nationkey]] AS re, [[im*s_nationkey]] AS im FROM sparse JOIN supplier ON coil=s_suppkey", "sparse")
def j2(s, d):
    w = M.table(s, d, "supplier").select(F.col("s_suppkey").alias("coil"), F.col("s_nationkey").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return out(J.diagonal(M.sparse(s, d), w, ["coil"]), "coil", "k")


@query("j3_positions", "+c AS (SELECT k, sum(re) AS re, sum(im) AS im FROM sparse GROUP BY k) SELECT p_partkey%7 AS frame, [[sum(re)]] AS re, [[sum(im)]] AS im FROM part JOIN c ON k = p_partkey-5 WHERE p_partkey-5>=0 GROUP BY 1", "sparse")
def j3(s, d):
    at = M.table(s, d, "part").select((F.col("p_partkey") % 7).alias("frame"), (F.col("p_partkey") - 5).alias("k"))
    return out(J.scatter(J.gather(J.scatter(M.sparse(s, d), ["k"]), at, ["k"]), ["frame"]), "frame")


@query("j4_consistency", "SELECT vec_id, y, x, [[CASE WHEN x%3=0 THEN 2*re ELSE re END]] AS re, [[im]] AS im FROM img", "img")
def j4(s, d):
    x = M.img(s, d)
    return out(J.data_consistency(x, E.scale(x, 2.0).where("x % 3 = 0"), IM), *IM)


@query("j4_robust", "SELECT vec_id, y, x, [[CASE WHEN x%3=0 AND abs(re)>0.1 THEN re+sign(re)*(abs(re)-0.1) ELSE re END]] AS re, [[im]] AS im FROM img", "img")
def j4_robust(s, d):
    x = M.img(s, d)
    return out(J.data_consistency(x, E.scale(x, 2.0).where("x % 3 = 0"), IM, 0.1), *IM)


@query("j5_matrix", "SELECT vec_id, v::INT AS v, [[sum(re*cos(v*c*0.1)-im*sin(v*c*0.1))]] AS re, [[sum(re*sin(v*c*0.1)+im*cos(v*c*0.1))]] AS im FROM coils, range(4) t(v) GROUP BY 1,2", "coils")
def j5(s, d):
    m = np.exp(0.1j * np.outer(np.arange(4), np.arange(32)))
    return out(T.apply_channels(M.coils(s, d), m, "vec_id", "c"), "vec_id", "v")


@query("j6_coil_combine", "+m AS (SELECT label, c, avg(re) AS mr, avg(im) AS mi FROM coils JOIN embeddings USING (vec_id) GROUP BY 1,2) SELECT vec_id, [[sum(mr*re+mi*im)]] AS re, [[sum(mr*im-mi*re)]] AS im FROM coils JOIN embeddings USING (vec_id) JOIN m USING (label,c) GROUP BY 1", "coils")
def j6(s, d):
    x = M.coils(s, d).join(M.table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    maps = x.groupBy("label", "c").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return out(J.fmac(x, maps, ["label", "c"], ["vec_id"], conjugate=True), "vec_id")


AXES = [("y", "cy", 8), ("x", "cx", 8)]


@query("j7_interpolate", "SELECT a.vec_id, a.y AS q, [[sum(b.re*(1-abs(0.9::DOUBLE*a.y+0.25-b.y))*(1-abs(0.7::DOUBLE*a.y+0.5-b.x)))]] AS re, 0.0::DOUBLE AS im FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.x=0 AND abs(0.9::DOUBLE*a.y+0.25-b.y)<1 AND abs(0.7::DOUBLE*a.y+0.5-b.x)<1 GROUP BY 1,2", "img")
def j7(s, d):
    x = M.img(s, d)
    at = x.where("x = 0").select("vec_id", F.col("y").alias("q"), (0.9 * F.col("y") + 0.25).alias("cy"), (0.7 * F.col("y") + 0.5).alias("cx"))
    return out(J.interpolate(x, at, AXES, ["q"], 1, ["vec_id"]), "vec_id", "q")


@query("j8_warp", "SELECT a.vec_id, a.y, a.x, [[sum(b.re*(1-abs(a.x+0.3::DOUBLE-b.x)))]] AS re, 0.0::DOUBLE AS im FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.y=b.y AND abs(a.x+0.3::DOUBLE-b.x)<1 WHERE a.x+0.3::DOUBLE<=7 GROUP BY 1,2,3", "img")
def j8(s, d):
    x = M.img(s, d)
    return out(J.warp(x, x.select(*IM, F.lit(0.0).alias("cy"), F.lit(0.3).alias("cx")), AXES, 1, ["vec_id"]), *IM)


@query("j9_affine", "+a AS (SELECT vec_id, 8-x AS y, y AS x, re FROM img WHERE x>0) SELECT vec_id, y, x, [[re]] AS re, 0.0::DOUBLE AS im FROM a", "img")
def j9(s, d):
    x = M.img(s, d)
    return out(J.affine(x, x.select(*IM), [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]], AXES, 1, ["vec_id"]), *IM)


ATOMS = np.exp(-np.outer(np.arange(1, 33) / 8.0, np.arange(1, 9)))


@query("j10_dictionary", "+a AS (SELECT k, e, exp(-(k+1)/8.0::DOUBLE*e) AS v FROM range(32) t(k), range(1,9) u(e)), n AS (SELECT k, sqrt(sum(v*v)) AS n FROM a GROUP BY k), m AS (SELECT p_partkey, sqrt(sum(re*re)) AS m FROM echo GROUP BY 1), c AS (SELECT p_partkey, k, round(sum(re*v)/any_value(m)/any_value(n),9) AS c FROM echo JOIN a USING (e) JOIN n USING (k) JOIN m USING (p_partkey) GROUP BY 1,2) SELECT p_partkey, arg_max(k, c)::DOUBLE AS atom, [[max(c)]] AS match FROM c GROUP BY 1", "echo")
def j10(s, d):
    return out(T.dictionary_match(M.echo(s, d), "p_partkey", "e", ATOMS), "p_partkey", values=("atom", "match"))


@query("j11_bin_labels", "SELECT user_id AS ch, event_type, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)-1)::INT AS slot, [[value]] AS re FROM events")
def j11(s, d):
    e = M.table(s, d, "events").select(F.col("user_id").alias("ch"), "event_type", "ts", "event_id", F.col("value").alias("re"))
    return out(W.bin_by_label(e, "event_type", ["ch"], ["ts", "event_id"]), "ch", "event_type", "slot", values=("re",))


# reductions


@query("a1_sum_mean", "+p AS (SELECT vec_id, y, sum(re)/8 AS re FROM img GROUP BY 1,2) SELECT vec_id, [[sum(re)]] AS re, 0.0::DOUBLE AS im FROM p GROUP BY 1", "img")
def a1(s, d):
    return out(A.total(A.total(M.img(s, d), ["vec_id", "y"], 8.0), ["vec_id"]), "vec_id")


def keyed(name: str, keys: tuple[str, ...], fn: Callable, sql: str, view: Callable = M.img, values: tuple[str, ...] = ("re", "im")) -> None:
    query(name, f"SELECT {', '.join(keys)}, {sql} FROM {view.__name__} GROUP BY {', '.join(keys)}", view.__name__)(lambda s, d: out(fn(view(s, d)), *keys, values=values))


keyed("a2_rss", ("vec_id",), lambda x: A.rss(x, ["vec_id"]), "[[sqrt(sum(re*re+im*im))]] AS re, 0.0::DOUBLE AS im", M.coils)
keyed("a3_var_std", ("vec_id",), lambda x: A.variance(x, ["vec_id"]), "[[var_samp(re)+var_samp(im)]] AS var, [[sqrt(var_samp(re)+var_samp(im))]] AS std", M.coils, ("var", "std"))
keyed("a1_weighted_mean", ("label", "x"), lambda x: A.weighted_mean(x.withColumn("re", F.when(F.col("re") > 0, F.col("re")).otherwise(0.0)), ["label", "x"]), "[[coalesce(sum(greatest(re,0))/nullif(sum((re>0)::INT),0),0)]] AS re, 0.0::DOUBLE AS im")
keyed("a4_minimum", ("vec_id", "y"), lambda x: A.projection(x, ["vec_id", "y"], minimum=True), "[[min(re)]] AS re, 0.0::DOUBLE AS im")
keyed("a4_mip", ("vec_id", "x"), lambda x: A.projection(x, ["vec_id", "x"]), "[[greatest(max(re),0)]] AS re, 0.0::DOUBLE AS im")


@query("a5_normalize", "+n AS (SELECT vec_id, sqrt(sum(re*re+im*im)) AS n FROM coils GROUP BY 1) SELECT vec_id, c, [[CASE WHEN n=0 THEN 0 ELSE re/n END]] AS re, [[CASE WHEN n=0 THEN 0 ELSE im/n END]] AS im FROM coils JOIN n USING (vec_id)", "coils")
def a5(s, d):
    return out(A.normalize(M.coils(s, d), ["vec_id"]), *CO)


@query("a6_sdot", "SELECT a.vec_id, [[sum(a.re*b.re)]] AS re, 0.0::DOUBLE AS im FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.y=b.y AND b.x=7-a.x GROUP BY 1", "img")
def a6(s, d):
    x = M.img(s, d)
    return out(A.inner_product(x, R.flip(x, {"x": 8}).select(*IM, "re", "im"), IM, ["vec_id"]), "vec_id")


@query("a7_hist")
def a7(s, d):
    return A.histogram(M.img(s, d), 16, ["label"]).select("label", "bin", F.col("n").cast("long").alias("n"))


ORACLES["a7_hist"] = "WITH " + VIEWS["img"] + ", h AS (SELECT label, floor((re+0.5)*16)::INT AS bin, count(*) AS n FROM img WHERE re>=-0.5 AND re<0.5 GROUP BY 1,2), k AS (SELECT label, b::INT AS bin FROM (SELECT DISTINCT label FROM img), range(16) t(b)) SELECT k.label, k.bin, coalesce(n,0)::BIGINT AS n FROM k LEFT JOIN h ON k.label=h.label AND k.bin=h.bin"


@query("a8_roistat", "SELECT label, count(*)::DOUBLE AS count, [[sum(re)]] AS sum, [[avg(re)]] AS mean, [[var_pop(re)*count(*)]] AS energy, [[var_pop(re)]] AS variance, [[stddev_pop(re)]] AS std FROM img GROUP BY 1", "img")
def a8(s, d):
    return out(A.region_statistics(M.img(s, d), "label"), "label", values=("count", "sum", "mean", "energy", "variance", "std"))


@query("a8_regions", "+g AS (SELECT g, y, x, (1+g*y)::DOUBLE AS w FROM range(3) a(g), range(8) b(y), range(8) c(x) WHERE y>=g AND x<8-g), s AS (SELECT g, label, sum(w) AS n, sum(w*re) AS s, sum(w*re*re) AS e FROM img JOIN g USING (y,x) GROUP BY 1,2) SELECT g::INT AS g, label, [[n]] AS count, [[s/n]] AS mean, [[(e-s*s/n)/(n-1)]] AS variance FROM s", "img")
def a8_regions(s, d):
    g = R.ones(s, {"g": 3, "y": 8, "x": 8}).where("y >= g AND x < 8 - g").withColumn("re", 1.0 + F.col("g") * F.col("y"))
    return out(A.weighted_regions(M.img(s, d), g, ["y", "x"], "g", ["label"], bessel=True), "g", "label", values=("count", "mean", "variance"))


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = M.img(s, d)
    return x, R.flip(x, {"x": 8}).select(*IM, "re", "im")


PAIR = "+p AS (SELECT a.vec_id, a.re AS x, b.re AS r FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.y=b.y AND b.x=7-a.x) "


@query("a9_mse", PAIR + "SELECT vec_id, [[sum((x-r)*(x-r))/64]] AS mse FROM p GROUP BY 1", "img")
def a9(s, d):
    return out(A.mse(*_pair(s, d), IM, ["vec_id"], 64), "vec_id", values=("mse",))


query("a10_nrmse", PAIR + "SELECT vec_id, [[sqrt(greatest(sum(x*x)-sum(x*r)*sum(x*r)/sum(r*r),0)/(sum(x*r)*sum(x*r)/sum(r*r)))]] AS nrmse FROM p GROUP BY 1", "img")(lambda s, d: out(A.nrmse(*_pair(s, d), IM, ["vec_id"], True), "vec_id", values=("nrmse",)))


@query("a11_psnr", PAIR + ", q AS (SELECT vec_id, max(abs(r)) AS m, sum((abs(x)-abs(r))*(abs(x)-abs(r)))/64 AS d FROM p GROUP BY 1) SELECT [[avg(20*log10(m)-10*log10(d))]] AS psnr FROM q", "img")
def a11(s, d):
    return out(A.psnr(*_pair(s, d), IM, ["vec_id"], 64), values=("psnr",))


def _tile_pair(s: SparkSession, d: str, fn: Callable) -> DataFrame:
    return fn(M.tile(s, d)).withColumns({"re2": F.reverse("re"), "im2": F.reverse("im")})


SSIM = (
    "+m AS (SELECT vec_id, max(abs(re)) AS m FROM img GROUP BY 1), p AS (SELECT a.vec_id, a.y, a.x, abs(a.re)/m AS a, abs(b.re)/m AS b FROM img a JOIN img b ON a.vec_id=b.vec_id AND b.y=7-a.y AND b.x=7-a.x JOIN m ON m.vec_id=a.vec_id), "
    "w AS (SELECT vec_id, u, v, avg(a) AS ma, avg(b) AS mb, avg(a*a) AS aa, avg(b*b) AS bb, avg(a*b) AS ab FROM p, range(2) r(u), range(2) t(v) WHERE y-u BETWEEN 0 AND 6 AND x-v BETWEEN 0 AND 6 GROUP BY 1,2,3) "
    "SELECT w.vec_id, label, [[avg((2*ma*mb+1e-4)*(2*(ab-ma*mb)+9e-4)/((ma*ma+mb*mb+1e-4)*(aa-ma*ma+bb-mb*mb+9e-4)))]] AS ssim FROM w JOIN embeddings e ON e.vec_id=w.vec_id GROUP BY 1,2"
)


@query("a12_ssim", SSIM, "img")
def a12(s, d):
    v = T.tile_values(_tile_pair(s, d, lambda t: t), None, lambda x, r: K.ssim(x, r)[:, None], ["ssim"], (("re", "im"), ("re2", "im2")))
    return out(v, "vec_id", "label", values=("ssim",))


@query("a13_data_scaling", "+q AS (SELECT ch, quantile_cont(abs(re),0.5) AS m, quantile_cont(abs(re),0.9) AS p, max(abs(re)) AS t FROM signal GROUP BY 1), v AS (SELECT ch, CASE WHEN t-p>=2*(p-m) THEN t ELSE p END AS v FROM q) SELECT ch, [[CASE WHEN v=0 THEN 1 ELSE v END]] AS scale FROM v", "signal")
def a13(s, d):
    return out(A.data_scaling(M.signal(s, d), ["ch"]), "ch", values=("scale",))


IDFT = "i AS (SELECT vec_id, coil, u::INT AS y, v::INT AS x, sum(re*cos(t)-im*sin(t))/4 AS re, sum(re*sin(t)+im*cos(t))/4 AS im FROM (SELECT k.*, u, v, 2*pi()*((u-2)*(y-2)+(v-2)*(x-2))/4 AS t FROM {0} k, range(4) a(u), range(4) b(v)) GROUP BY 1,2,3,4)"
LOW = "l AS (SELECT * FROM kspace WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2), "


def _rss_of_centre(s: SparkSession, d: str, size: int) -> DataFrame:
    """Magnitudes of the centre of k-space: cropped, transformed, root of sums of squares over the coils."""

    def image(y: np.ndarray) -> np.ndarray:
        y = y[:, :, max(0, y.shape[2] // 2 - size // 2) :][:, :, :size, max(0, y.shape[3] // 2 - size // 2) :][..., :size]
        return np.sqrt((np.abs(K.fft(y, (2, 3), inverse=True, unitary=True)) ** 2).sum(1))

    return M.tiles_to_cells(T.tile_map(M.kspace(s, d), None, image), ["y", "x"])


@query("a13_scaling_from_kspace", "+" + IDFT.format("kspace") + ", r AS (SELECT vec_id, y, x, sqrt(sum(re*re+im*im)) AS re FROM i GROUP BY 1,2,3), q AS (SELECT vec_id, quantile_cont(re,0.5) AS m, quantile_cont(re,0.9) AS p, max(re) AS t FROM r GROUP BY 1), v AS (SELECT vec_id, CASE WHEN t-p>=2*(p-m) THEN t ELSE p END AS v FROM q) SELECT vec_id, [[CASE WHEN v=0 THEN 1 ELSE v END]] AS scale FROM v", "kspace")
def a13_kspace(s, d):
    return out(A.data_scaling(_rss_of_centre(s, d, 32), ["vec_id"]), "vec_id", values=("scale",))


@query("a14_covariance", "SELECT a.c AS i, b.c AS j, [[avg(a.re*b.re+a.im*b.im)]] AS re, [[avg(a.im*b.re-a.re*b.im)]] AS im FROM coils a JOIN coils b ON a.vec_id=b.vec_id AND b.c>=a.c GROUP BY 1,2", "coils")
def a14(s, d):
    return out(A.channel_gram(M.coils(s, d), "vec_id", "c", 32), "i", "j")


@query("a15_density", "SELECT k, count(*) AS n, [[1.0::DOUBLE/count(*)]] AS weight, [[greatest(sqrt(k*k*0.0001),0.25)]] AS radial FROM sparse GROUP BY k", "sparse")
def a15(s, d):
    x = A.density(M.sparse(s, d), ["k"])
    return out(x.withColumn("radial", A.radial_weight(F.col("k") * 0.01, F.lit(0.0))), "k", "n", values=("weight", "radial"))


@query("a16_top_k", "+m AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(re*re+im*im,12) DESC, c) AS n FROM coils) SELECT vec_id, c, [[re]] AS re, [[im]] AS im FROM coils JOIN m USING (vec_id,c) WHERE n<=5", "coils")
def a16(s, d):
    return out(A.top_k(M.coils(s, d), ["vec_id"], [], ["c"], 5), *CO)


# windows
@query("w1_moving_average", "+w AS (SELECT ch, i, avg(re) OVER k AS re, count(*) OVER k AS n FROM signal WINDOW k AS (PARTITION BY ch ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT ch, i, [[re]] AS re FROM w WHERE n=5", "signal")
def w1(s, d):
    return out(W.moving_average(M.signal(s, d), ["ch"], "i", 5), "ch", "i", values=("re",))


@query("w2_median", "+w AS (SELECT ch, i, median(re) OVER k AS re, count(*) OVER k AS n FROM signal WINDOW k AS (PARTITION BY ch ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT ch, i, [[re]] AS re FROM w WHERE n=4", "signal")
def w2(s, d):
    return out(W.median_filter(M.signal(s, d), ["ch"], "i", 4), "ch", "i", values=("re",))


@query("w3_geometric_median")
def w3(s, d):
    return out(W.geometric_median(M.coils(s, d), ["vec_id"], "c", 5), *CO)


@query("w4_unwrap", "+a AS (SELECT ch, i, re, re-lag(re) OVER (PARTITION BY ch ORDER BY i) AS d FROM signal), f AS (SELECT ch, i, re, coalesce(CASE WHEN abs(d)>20 THEN -sign(d)*ceil(abs(d)/20)*20 ELSE 0 END,0) AS f FROM a) SELECT ch, i, [[re+sum(f) OVER (PARTITION BY ch ORDER BY i)]] AS re FROM f", "signal")
def w4(s, d):
    return out(W.unwrap(M.signal(s, d), ["ch"], "i", 20.0), "ch", "i", values=("re",))


@query("w5_hankel", "SELECT ch, i, [[re*(least(i,n-4)-greatest(i-3,0)+1)]] AS re FROM (SELECT *, count(*) OVER (PARTITION BY ch) AS n FROM signal) WHERE n>=4", "signal")
def w5(s, d):
    x = M.signal(s, d).withColumn("n", W.length_of(["ch"]))
    return out(W.hankel_adjoint(W.hankel(x, "i", F.col("n"), 4), ["ch"], "i"), "ch", "i", values=("re",))


@query("w6_casorati", "SELECT vec_id, (p*3+q)::INT AS element, ((y-p)*6+(x-q))::INT AS block, [[re]] AS re FROM img, range(3) a(p), range(3) b(q) WHERE y-p BETWEEN 0 AND 5 AND x-q BETWEEN 0 AND 5", "img")
def w6(s, d):
    return out(W.casorati(M.img(s, d), [("y", 8, 3), ("x", 8, 3)]), "vec_id", "element", "block", values=("re",))


@query("w7_gradient", "SELECT 0 AS d, a.vec_id, a.y, a.x, [[b.re-a.re]] AS re FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.x=b.x AND b.y=(a.y+1)%8 UNION ALL SELECT 1, a.vec_id, a.y, a.x, [[b.re-a.re]] FROM img a JOIN img b ON a.vec_id=b.vec_id AND a.y=b.y AND b.x=(a.x+1)%8", "img")
def w7(s, d):
    return out(W.gradient(M.img(s, d), ["vec_id"], ["y", "x"]), "d", *IM, values=("re",))


@query("w8_conv", "SELECT vec_id, y, ((x+j-1+8)%8)::INT AS x, [[sum(re*([0.25,0.5,0.125])[j+1])]] AS re FROM img, range(3) t(j) GROUP BY 1,2,3", "img")
def w8(s, d):
    return out(W.convolve(M.img(s, d), [0.25, 0.5, 0.125], ["vec_id", "y"], "x", 8), *IM, values=("re",))


@query("w8_modes", "+n AS (SELECT ch, count(*) AS n FROM signal GROUP BY 1), f AS (SELECT ch, i+j AS i, sum(re*([0.25,0.5,0.125])[j+1]) AS re FROM signal, range(3) t(j) GROUP BY 1,2) SELECT ch, 'full' AS mode, i::INT AS i, [[re]] AS re FROM f UNION ALL SELECT ch, 'same', (i-1)::INT, [[re]] FROM f JOIN n USING (ch) WHERE i>=1 AND i<=n UNION ALL SELECT ch, 'valid', (i-2)::INT, [[re]] FROM f JOIN n USING (ch) WHERE i>=2 AND i<n", "signal")
def w8_modes(s, d):
    x = M.signal(s, d).withColumn("n", W.length_of(["ch"]))
    parts = [W.convolve(x, [0.25, 0.5, 0.125], ["ch"], "i", F.col("n"), mode).withColumn("mode", F.lit(mode)) for mode in ("full", "same", "valid")]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]), "ch", "mode", "i", values=("re",))


@query("w9_ssa")
def w9(s, d):
    return out(T.singular_spectrum(M.signal(s, d), ["ch"], "i", 8, 2), "ch", "i", values=("re",))


@query("w9_full_rank", "+m AS (SELECT ch, avg(re) AS m FROM signal GROUP BY 1) SELECT ch, i, round((pi()*(re-m))::DOUBLE,5)+0.0::DOUBLE AS re FROM signal JOIN m USING (ch)", "signal")
def w9_full(s, d):
    """With all vectors the decomposition gives the series without its mean (times pi: the plain values lie on ties of rounding)."""
    return T.singular_spectrum(M.signal(s, d), ["ch"], "i", 4, 4).select("ch", "i", M.rounded(F.col("re") * math.pi, 5).alias("re"))


@query("w10_phase_bins", "SELECT vec_id, c, least(floor((CASE WHEN atan2(im,re)<0 THEN atan2(im,re)+2*3.141592653589793 ELSE atan2(im,re) END)*6/(2*3.141592653589793)),5)::INT AS bin FROM coils", "coils")
def w10(s, d):
    return W.phase_bins(M.coils(s, d), "re", "im", 6).select(*CO, "bin")


@query("w10_amplitude_and_two_way_bins", "+w AS (SELECT ch, i, ntile(4) OVER (PARTITION BY ch ORDER BY re, i)-1 AS a, ntile(3) OVER (PARTITION BY ch ORDER BY -re, i)-1 AS b FROM signal) SELECT ch, i, (a*3+b)::INT AS bin FROM w", "signal")
def w10_more(s, d):
    x = W.amplitude_bins(M.signal(s, d), ["ch"], "re", "i", 4).withColumnRenamed("bin", "a").withColumn("m", -F.col("re"))
    return W.two_way_bins(W.amplitude_bins(x, ["ch"], "m", "i", 3).withColumnRenamed("bin", "b"), ("a", 4), ("b", 3)).select("ch", "i", "bin")


@query("w10_smoothed", "+m AS (SELECT vec_id, c, re - avg(re) OVER k AS re, im - avg(im) OVER k AS im FROM coils WINDOW k AS (PARTITION BY vec_id ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT vec_id, c, least(floor((CASE WHEN atan2(im,re)<0 THEN atan2(im,re)+2*3.141592653589793 ELSE atan2(im,re) END)*6/(2*3.141592653589793)),5)::INT AS bin FROM m", "coils")
def w10_smoothed(s, d):
    return W.smooth_phase_bins(M.coils(s, d), ["vec_id"], "c", "re", "im", 7, 6).select(*CO, "bin")


# dense transforms
DFT = "SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t))]] AS re, [[-sum(re*sin(t))]] AS im FROM (SELECT vec_id, u, v, re, 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 AS t FROM img, range(8) a(u), range(8) b(v)) GROUP BY 1,2,3"


@query("t1_fft", DFT, "img")
def t1(s, d):
    return out(M.tiles_to_cells(T.fft(M.tile(s, d), (8, 8)), ["y", "x"], [8, 8]), *IM)


@query("t1_fft_128", "+m AS (SELECT DISTINCT floor(vec_id/256)::BIGINT AS m FROM embeddings), p AS (SELECT floor(vec_id/256)::BIGINT AS m, sum(re*re) AS e FROM img GROUP BY 1) SELECT m, [[e]] AS energy, 16384::BIGINT AS n FROM p", "img")
def t1_large(s, d):
    """256 images side by side as 128 x 128 (missing ones are zero), transformed: the energy stays."""
    at = F.pmod("vec_id", F.lit(256))
    x = M.img(s, d).select(F.floor(F.col("vec_id") / 256).alias("m"), (F.col("y") + F.floor(at / 16) * 8).cast("int").alias("y"), (F.col("x") + at % 16 * 8).cast("int").alias("x"), "re", "im")
    k = T.fft(M.cells_to_tiles(x, ["m"], ["y", "x"], [128, 128]), None, unitary=True)
    e = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, v: a + v)
    return k.select("m", M.rounded(e).alias("energy"), F.size("re").cast("long").alias("n"))


VOLUME = "+c AS (SELECT (vec_id//10)::BIGINT AS g, (vec_id%10)::INT AS z, y, x, re FROM img), a AS (SELECT g, u::INT AS z, y, x, sum(re*cos(2*pi()*(u-5)*(z-5)/10)) AS re, -sum(re*sin(2*pi()*(u-5)*(z-5)/10)) AS im FROM c, range(10) r(u) GROUP BY 1,2,3,4), b AS (SELECT g, z, u::INT AS y, x, sum(re*cos(w)+im*sin(w)) AS re, sum(im*cos(w)-re*sin(w)) AS im FROM (SELECT *, 2*pi()*(u-4)*(y-4)/8 AS w FROM a, range(8) r(u)) GROUP BY 1,2,3,4) SELECT g, z, y, u::INT AS x, [[sum(re*cos(w)+im*sin(w))]] AS re, [[sum(im*cos(w)-re*sin(w))]] AS im FROM (SELECT *, 2*pi()*(u-4)*(x-4)/8 AS w FROM b, range(8) r(u)) GROUP BY 1,2,3,4"


@query("t1_volume", VOLUME, "img")
def t1_volume(s, d):
    """Ten images as a volume, an axis at a time; the lines along z are split in factors."""
    x = M.img(s, d).select(F.floor(F.col("vec_id") / 10).alias("g"), (F.col("vec_id") % 10).cast("int").alias("z"), "y", "x", "re", "im")
    return out(L.fft(x, {"z": 10, "y": 8, "x": 8}, most=8), "g", "z", "y", "x")


@query("t1_long_line", "+c AS (SELECT (vec_id//8)::BIGINT AS g, ((vec_id%8)*64+y*8+x)::INT AS j, re FROM img) SELECT g, k::INT AS k, [[sum(re*cos(2*pi()*((k-256)*(j-256)%512)/512))]] AS re, [[-sum(re*sin(2*pi()*((k-256)*(j-256)%512)/512))]] AS im FROM c, range(512) r(k) GROUP BY 1,2", "img")
def t1_long_line(s, d):
    """Eight vectors end to end, transformed without ever gathering the line: 512 = 16 x (16 x 2)."""
    x = M.img(s, d).select(F.floor(F.col("vec_id") / 8).alias("g"), ((F.col("vec_id") % 8) * 64 + F.col("y") * 8 + F.col("x")).cast("int").alias("k"), "re", "im")
    return out(L.fft_axis(x, "k", 512, most=16), "g", "k")


def _spokes() -> np.ndarray:
    t = np.arange(6) * np.pi / 6
    r = np.arange(8) - 4
    return np.stack([np.outer(np.sin(t), r).ravel(), np.outer(np.cos(t), r).ravel()], 1)


NUFFT = "+k AS (SELECT (sp*8+q)::INT AS s, (q-4)*sin(sp*pi()/6) AS ky, (q-4)*cos(sp*pi()/6) AS kx FROM range(6) a(sp), range(8) b(q)), y AS (SELECT vec_id, s, sum(re*cos(2*pi()*(ky*(y-4)+kx*(x-4))/8))/8 AS re, -sum(re*sin(2*pi()*(ky*(y-4)+kx*(x-4))/8))/8 AS im FROM img, k GROUP BY 1,2) "


def _samples(s: SparkSession, d: str) -> DataFrame:
    k = _spokes()
    return T.nufft(M.tile(s, d), (8, 8), k)


@query("t2_nufft", NUFFT + "SELECT vec_id, s, [[re]] AS re, [[im]] AS im FROM y", "img")
def t2(s, d):
    return out(M.tiles_to_cells(_samples(s, d), ["s"], [48]), "vec_id", "s")


@query("t3_nufft_adjoint", NUFFT + "SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t)-im*sin(t))/8]] AS re, [[sum(re*sin(t)+im*cos(t))/8]] AS im FROM (SELECT y.*, u, v, 2*pi()*(ky*(u-4)+kx*(v-4))/8 AS t FROM y JOIN k USING (s), range(8) a(u), range(8) b(v)) GROUP BY 1,2,3", "img")
def t3(s, d):
    k = _spokes()
    im = T.nufft_adjoint(_samples(s, d), (8, 8), k)
    return out(M.tiles_to_cells(im, ["y", "x"], [8, 8]), *IM)


@query("t3_gridded", NUFFT + "SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t)-im*sin(t))/8]] AS re, [[sum(re*sin(t)+im*cos(t))/8]] AS im FROM (SELECT y.*, u, v, 2*pi()*(ky*(u-4)+kx*(v-4))/8 AS t FROM y JOIN k USING (s), range(8) a(u), range(8) b(v)) GROUP BY 1,2,3", "img")
def t3_gridded(s, d):
    """The same adjoint over cells: samples join their positions, meet by image and are gridded there."""
    k = _spokes()
    route = s.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(k)], "s int, ky double, kx double")
    im = N.grid_adjoint(M.tiles_to_cells(_samples(s, d), ["s"], [48]), (route, ["s"]), ["vec_id"], ["ky", "kx"], (8, 8), width=14, route_rows=len(k))
    return out(M.tiles_to_cells(im, ["y", "x"], [8, 8]), *IM)


@query("t4_psf", "+k AS (SELECT l_suppkey AS g, l_linenumber AS a, count(*) AS w, (l_linenumber-4)*0.9::DOUBLE AS kx FROM lineitem GROUP BY 1,2,4) SELECT g, m::INT AS m, [[sum(w*cos(2*pi()*kx*(m-8)/8))/8]] AS re, [[sum(w*sin(2*pi()*kx*(m-8)/8))/8]] AS im FROM k, range(16) t(m) GROUP BY 1,2")
def t4(s, d):
    k = M.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), ((F.col("l_linenumber") - 4) * 0.9).alias("kx")).agg(F.count("*").alias("w"))
    t = F.col("kx") * (F.col("m") - 8) * (2 * math.pi / 8)
    p = k.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return out(p.groupBy("g", "m").agg((F.sum(F.col("w") * F.cos(t)) / 8).alias("re"), (F.sum(F.col("w") * F.sin(t)) / 8).alias("im")), "g", "m")


def _mosaic(s: SparkSession, d: str) -> DataFrame:
    """Four images side by side as 16 x 16; missing ones are zero."""
    x = M.img(s, d).select(F.floor(F.col("vec_id") / 4).alias("m"), (F.col("y") + F.floor(F.pmod("vec_id", F.lit(4)) / 2) * 8).cast("int").alias("y"), (F.col("x") + F.pmod("vec_id", F.lit(2)) * 8).cast("int").alias("x"), "re", "im")
    return M.cells_to_tiles(x, ["m"], ["y", "x"], [16, 16])


@query("t4_psf_plane", "+k AS (SELECT (sp*8+q)::INT AS s, (q-4)*sin(sp*pi()/6) AS ky, (q-4)*cos(sp*pi()/6) AS kx FROM range(6) a(sp), range(8) b(q)), w AS (SELECT vec_id, (i)::INT AS s, embedding[i+1]::DOUBLE*embedding[i+1]::DOUBLE AS w FROM embeddings, range(48) t(i)) SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(w*cos(2*pi()*(ky*(u-8)+kx*(v-8))/8))/64]] AS re, [[sum(w*sin(2*pi()*(ky*(u-8)+kx*(v-8))/8))/64]] AS im FROM w JOIN k USING (s), range(16) a(u), range(16) b(v) GROUP BY 1,2,3")
def t4_plane(s, d):
    w = M.tile(s, d).withColumns({"re": F.slice("re", 1, 48), "im": F.slice("im", 1, 48)}).drop("shape")
    return out(M.tiles_to_cells(T.psf(w, _spokes(), (8, 8)), ["y", "x"], [16, 16]), *IM)


@query("t5_wavelet")
def t5(s, d):
    return out(M.tiles_to_cells(T.tile_map(_mosaic(s, d), None, lambda x: K.wavelet_soft(x, 0.05, "cdf44")), ["y", "x"]), "m", "y", "x", values=("re",))


@query("t5_haar_level", "+p AS (SELECT floor(vec_id/4)::BIGINT AS m, (y+floor((vec_id%4)/2)*8)::INT AS y, (x+(vec_id%2)*8)::INT AS x, re FROM img), z AS (SELECT m, a.y::INT AS y, b.x::INT AS x FROM (SELECT DISTINCT m FROM p), range(16) a(y), range(16) b(x)), f AS (SELECT z.*, coalesce(re,0) AS re FROM z LEFT JOIN p ON p.m=z.m AND p.y=z.y AND p.x=z.x) SELECT m, c::INT AS c, [[sum(CASE WHEN ((c//64)//2=1 AND y%2=1) <> ((c//64)%2=1 AND x%2=1) THEN -re ELSE re END)/2]] AS re FROM f JOIN range(256) r(c) ON (c%64)//8=y//2 AND c%8=x//2 GROUP BY 1,2", "img")
def t5_haar(s, d):
    return out(M.tiles_to_cells(T.tile_map(_mosaic(s, d), None, lambda x: K.fwt(x, (1, 2), "haar")), ["c"]), "m", "c", values=("re",))


@query("t6_svd", "SELECT vec_id, c, [[re]] AS re, [[im]] AS im FROM coils", "coils")
def t6(s, d):
    """U, singular values and V of the samples by channels matrix, multiplied again."""
    x = M.coils(s, d)
    sv, v = T.singular_values(x, "vec_id", "c", 32)
    u = T.apply_channels(x, (v / np.maximum(sv, 1e-12)).T, "vec_id", "c", "k")
    return out(T.apply_channels(u, np.conj(v) * sv, "vec_id", "k", "c"), *CO)


@query("t7_cc")
def t7(s, d):
    return out(T.apply_channels(M.coils(s, d), T.coil_compression(M.coils(s, d), "vec_id", "c", 32, 6), "vec_id", "c"), "vec_id", "v")


@query("t7_energy", "SELECT vec_id, [[sqrt(sum(re*re+im*im))]] AS re, 0.0::DOUBLE AS im FROM coils GROUP BY 1", "coils")
def t7_energy(s, d):
    """As many virtual coils as coils: nothing of the energy is lost."""
    return out(A.rss(T.apply_channels(M.coils(s, d), T.coil_compression(M.coils(s, d), "vec_id", "c", 32, 32), "vec_id", "c"), ["vec_id"]), "vec_id")


@query("t8_whiten", "SELECT i::INT AS i, j::INT AS j, (i=j)::INT::DOUBLE AS re, 0.0::DOUBLE AS im FROM range(32) a(i), range(32) b(j) WHERE j>=i")
def t8(s, d):
    x = T.apply_channels(M.coils(s, d), T.whitening(M.coils(s, d), "vec_id", "c", 32), "vec_id", "c")
    return out(A.channel_gram(x, "vec_id", "v", 32), "i", "j")


@query("t9_rovir")
def t9(s, d):
    x = M.coils(s, d).join(M.table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    m = T.region_optimised(T.covariance(x.where("label < 5"), "vec_id", "c", 32), T.covariance(x.where("label >= 5"), "vec_id", "c", 32), 4)
    return out(T.apply_channels(M.coils(s, d), m, "vec_id", "c"), "vec_id", "v")


@query("t10_calmat", "SELECT vec_id, (p*2+q)::INT AS element, ((y-2-p)*3+(x-2-q))::INT AS block, [[re]] AS re FROM img, range(2) a(p), range(2) b(q) WHERE y-2-p BETWEEN 0 AND 2 AND x-2-q BETWEEN 0 AND 2 AND y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5", "img")
def t10(s, d):
    return out(W.casorati(R.extract(M.img(s, d), {"y": (2, 6), "x": (2, 6)}), [("y", 4, 2), ("x", 4, 2)]), "vec_id", "element", "block", values=("re",))


def _own_maps(s: SparkSession, d: str) -> DataFrame:
    return C.caldir(M.kspace(s, d), 2)


def _pattern(s: SparkSession, d: str) -> DataFrame:
    """A pattern per label: every second line for odd labels, every one for even ones, and the two in the middle."""
    line = lambda p: ((F.floor(p / 4) % (1 + F.col("label") % 2) == 0) | F.floor(p / 4).between(1, 2)).cast("double")
    p = M.table(s, d, "embeddings").select("label").distinct().withColumn("re", F.transform(F.sequence(F.lit(0), F.lit(15)), line))
    return p.withColumn("im", F.transform("re", lambda v: v * 0))


PATTERN = "(y % (1+label%2)=0 OR y BETWEEN 1 AND 2)"


def _sides(s: SparkSession, d: str) -> tuple:
    """k-space, and the maps of every item and the pattern of every label as tables."""
    return M.kspace(s, d), (_own_maps(s, d), ["vec_id"]), (_pattern(s, d), ["label"])


def _coil_cells(df: DataFrame) -> DataFrame:
    return out(M.tiles_to_cells(df, ["coil", "y", "x"]), "vec_id", "coil", "y", "x")


MAPS = LOW + IDFT.format("l") + ", n AS (SELECT vec_id, y, x, greatest(sqrt(sum(re*re+im*im)),1e-12) AS n FROM i GROUP BY 1,2,3), m AS (SELECT vec_id, coil, y, x, re/n AS re, im/n AS im FROM i JOIN n USING (vec_id,y,x))"
query("t11_caldir", "+" + MAPS + " SELECT vec_id, coil, y, x, [[re]] AS re, [[im]] AS im FROM m", "kspace")(lambda s, d: _coil_cells(_own_maps(s, d)))
query("t12_walsh")(lambda s, d: _coil_cells(C.walsh(M.kspace(s, d))))
query("t12_single_voxel", "+" + IDFT.format("kspace") + ", n AS (SELECT vec_id, y, x, sqrt(sum(re*re+im*im)) AS n, max(CASE WHEN coil=0 THEN re END) AS fr, max(CASE WHEN coil=0 THEN im END) AS fi FROM i GROUP BY 1,2,3) SELECT vec_id, coil, y, x, [[(re*fr+im*fi)/n/sqrt(fr*fr+fi*fi)]] AS re, [[(im*fr-re*fi)/n/sqrt(fr*fr+fi*fi)]] AS im FROM i JOIN n USING (vec_id,y,x)", "kspace")(lambda s, d: _coil_cells(C.walsh(M.kspace(s, d), 1)))
query("t13_ecalib")(lambda s, d: _coil_cells(C.ecalib(M.kspace(s, d), 2, 0.02, 0.5)))
UNITARY = "f AS (SELECT vec_id, u::INT AS y, v::INT AS x, sum(re*cos(t))/8 AS re, -sum(re*sin(t))/8 AS im FROM (SELECT vec_id, u, v, re, 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 AS t FROM img, range(8) a(u), range(8) b(v)) GROUP BY 1,2,3)"


@query("t14_kernels", "+" + UNITARY + " SELECT vec_id, y-2 AS y, x-2 AS x, [[re]] AS re, [[im]] AS im FROM f WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5", "img")
def t14(s, d):
    return out(M.tiles_to_cells(C.maps_to_kernels(M.tile(s, d), 4), ["y", "x"]), *IM)


@query("t14_maps", "+" + UNITARY + " SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t)-im*sin(t))/8]] AS re, [[sum(re*sin(t)+im*cos(t))/8]] AS im FROM (SELECT f.*, u, v, 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 AS t FROM f, range(8) a(u), range(8) b(v) WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) GROUP BY 1,2,3", "img")
def t14_maps(s, d):
    return out(M.tiles_to_cells(C.kernels_to_maps(C.maps_to_kernels(M.tile(s, d), 4), (8, 8)), ["y", "x"]), *IM)


@query("t15_low_rank")
def t15(s, d):
    t = M.tile(s, d).withColumns({"g": F.floor(F.col("vec_id") / 8), "frame": (F.col("vec_id") % 8).cast("int")})
    return out(M.tiles_to_cells(B.locally_low_rank(t, "g", "frame", (8, 8), 4, 0.2), ["y", "x"], [8, 8]), "g", "frame", "y", "x", values=("re",))


@query("t15_single_frame", "+b AS (SELECT vec_id, y//4 AS p, x//4 AS q, sqrt(sum(re*re)) AS n FROM img GROUP BY 1,2,3) SELECT vec_id AS g, 0 AS frame, y, x, [[CASE WHEN n=0 THEN 0 ELSE re*greatest(1-0.2/n,0) END]] AS re FROM img JOIN b ON b.vec_id=img.vec_id AND p=y//4 AND q=x//4".replace("SELECT vec_id AS g", "SELECT img.vec_id AS g"), "img")
def t15_single(s, d):
    """One frame: a block has one singular value, its norm."""
    t = M.tile(s, d).withColumns({"g": F.col("vec_id"), "frame": F.lit(0)})
    return out(M.tiles_to_cells(B.locally_low_rank(t, "g", "frame", (8, 8), 4, 0.2), ["y", "x"], [8, 8]), "g", "frame", "y", "x", values=("re",))


@query("t16_estshift", "SELECT vec_id, 1.0::DOUBLE AS dy, 0.0::DOUBLE AS dx FROM embeddings")
def t16(s, d):
    x = M.tile(s, d).withColumns({"re2": F.concat(F.slice("re", 9, 56), F.slice("re", 1, 8)), "im2": F.col("im")})
    return out(T.tile_values(x, (8, 8), K.shift, ["dy", "dx"], (("re", "im"), ("re2", "im2"))), "vec_id", values=("dy", "dx"))


# reconstruction and fits


def _image(df: DataFrame) -> DataFrame:
    return out(M.tiles_to_cells(df, ["y", "x"]), *IM)


def sense(k: str) -> str:
    """SQL of the SENSE adjoint a of the k-space table k, whose rows carry the pattern already."""
    return f"s AS (SELECT vec_id, coil, u::INT AS y, v::INT AS x, sum(re*cos(t)-im*sin(t))/4 AS re, sum(re*sin(t)+im*cos(t))/4 AS im FROM (SELECT k.*, u, v, 2*pi()*((u-2)*(y-2)+(v-2)*(x-2))/4 AS t FROM {k} k, range(4) a(u), range(4) b(v)) GROUP BY 1,2,3,4), a AS (SELECT vec_id, y, x, sum(m.re*s.re+m.im*s.im) AS re, sum(m.re*s.im-m.im*s.re) AS im FROM s JOIN m USING (vec_id,coil,y,x) GROUP BY 1,2,3)"


SAMPLED = f", k AS (SELECT * FROM kspace WHERE {PATTERN})"
query("b1_sense", "+" + MAPS + SAMPLED + ", " + sense("k") + " SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM a", "kspace")(lambda s, d: _image(B.sense_adjoint(*_sides(s, d))))
FIXED = np.stack([np.exp(0.3j * np.add.outer(np.arange(8), c * np.arange(8))) / 2 for c in range(4)])


BASIS = np.stack([np.cos(0.4 * np.arange(3)), np.sin(0.4 * np.arange(3))])


@query("b1_subspace", "+c AS (SELECT vec_id, coil AS t, y, x, re, im FROM (SELECT vec_id, (i//16)::INT AS coil, ((i%16)//4)::INT AS y, (i%4)::INT AS x, embedding[i+1]::DOUBLE AS re, 0.0::DOUBLE AS im FROM embeddings, range(48) t(i))), i AS (SELECT vec_id, t, u::INT AS y, v::INT AS x, sum(re*cos(p))/4 AS re, sum(re*sin(p))/4 AS im FROM (SELECT c.*, u, v, 2*pi()*((u-2)*(y-2)+(v-2)*(x-2))/4 AS p FROM c, range(4) a(u), range(4) b(v) WHERE (y+t)%2=0) GROUP BY 1,2,3,4) SELECT vec_id, a::INT AS a, y, x, [[sum(re*CASE WHEN a=0 THEN cos(0.4*t) ELSE sin(0.4*t) END)]] AS re, [[sum(im*CASE WHEN a=0 THEN cos(0.4*t) ELSE sin(0.4*t) END)]] AS im FROM i, range(2) r(a) GROUP BY 1,2,3,4")
def b1_subspace(s, d):
    """Three frames of one coil of 4 x 4, of each of which every second line is known, to two coefficients."""
    k = M.tile(s, d).withColumns({"re": F.slice("re", 1, 48), "im": F.slice("im", 1, 48)}).drop("shape")
    mask = np.stack([np.repeat(((np.arange(4) + t) % 2 == 0).astype(float)[:, None], 4, 1) for t in range(3)])
    return out(M.tiles_to_cells(B.subspace_adjoint(k, (3, 1, 4, 4), np.ones((1, 4, 4)), mask, BASIS), ["a", "y", "x"]), "vec_id", "a", "y", "x")


READ = "+{maps}, p AS (SELECT label, t::INT AS t, s::INT AS s, (label+3*t+2*s)%5-1 AS line FROM (SELECT DISTINCT label FROM embeddings), range(2) a(t), range(2) b(s)), k AS (SELECT vec_id, e.label, (i//16)::INT AS t, ((i%16)//8)::INT AS s, ((i%8)//4)::INT AS coil, (i%4)::INT AS x, embedding[i+1]::DOUBLE AS re, embedding[i+33]::DOUBLE AS im FROM embeddings e, range(32) r(i)), g AS (SELECT vec_id, coil, a::INT AS a, line AS y, x, sum(re*CASE WHEN a=0 THEN cos(0.4*t) ELSE sin(0.4*t) END) AS re, sum(im*CASE WHEN a=0 THEN cos(0.4*t) ELSE sin(0.4*t) END) AS im FROM k JOIN p USING (label,t,s), range(2) r(a) WHERE line>=0 GROUP BY 1,2,3,4,5), i2 AS (SELECT vec_id, coil, a, u::INT AS y, v::INT AS x, sum(re*cos(w)-im*sin(w))/4 AS re, sum(re*sin(w)+im*cos(w))/4 AS im FROM (SELECT g.*, u, v, 2*pi()*((u-2)*(y-2)+(v-2)*(x-2))/4 AS w FROM g, range(4) b(u), range(4) c(v)) GROUP BY 1,2,3,4,5) SELECT vec_id, a, y, x, [[sum(m.re*i2.re+m.im*i2.im)]] AS re, [[sum(m.re*i2.im-m.im*i2.re)]] AS im FROM i2 JOIN m USING (vec_id,coil,y,x) GROUP BY 1,2,3,4"


@query("b1_positions", READ.format(maps=MAPS), "kspace")
def b1_positions(s, d):
    """Two frames of two readouts, lines by label with repeats and padding, to two coefficients with each item's maps."""
    e = M.table(s, d, "embeddings").select("label").distinct()
    at = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("label") + 3 * F.floor(i / 2) + 2 * (i % 2)) % 5 - 1).cast("int"))
    got = P.adjoint(M.kspace(s, d).drop("shape"), (_own_maps(s, d), ["vec_id"]), (e.select("label", at.alias("lines")), ["label"]), BASIS[:, :2], 2, 2, (4, 4))
    return out(M.tiles_to_cells(got, ["a", "y", "x"]), "vec_id", "a", "y", "x")


@query("b2_noncartesian")
def b2(s, d):
    k = _spokes()
    w = np.hypot(k[:, 0], k[:, 1]) / 4 + 0.25
    return _image(B.nufft_sense_adjoint(B.nufft_sense(M.tile(s, d), (8, 8), FIXED, k, w), FIXED, k, w))


@query("b2_samples", "+k AS (SELECT (sp*8+q)::INT AS s, (q-4)*sin(sp*pi()/6) AS ky, (q-4)*cos(sp*pi()/6) AS kx FROM range(6) a(sp), range(8) b(q)), e AS (SELECT vec_id, c::INT AS coil, s, re, 0.3*(y+c*x) - 2*pi()*(ky*(y-4)+kx*(x-4))/8 AS t, sqrt(ky*ky+kx*kx)/4+0.25 AS w FROM img, k, range(4) r(c)) SELECT vec_id, coil, s, [[sum(w*re*cos(t))/16]] AS re, [[sum(w*re*sin(t))/16]] AS im FROM e GROUP BY 1,2,3", "img")
def b2_samples(s, d):
    k = _spokes()
    y = B.nufft_sense(M.tile(s, d), (8, 8), FIXED, k, np.hypot(k[:, 0], k[:, 1]) / 4 + 0.25)
    return out(M.tiles_to_cells(y, ["coil", "s"]), "vec_id", "coil", "s")


JITTER = "+k AS (SELECT label, s::INT AS s, s//8-4+0.3*sin(label+s) AS ky, s%8-4+0.3*cos(label+2*s) AS kx, 1.0::DOUBLE+s%2*0.5 AS w FROM (SELECT DISTINCT label FROM embeddings), range(64) t(s))"


def _jittered(s: SparkSession, d: str) -> tuple:
    """A trajectory near the grid points and four maps for every label."""
    own = M.table(s, d, "embeddings").select("label").distinct()
    at = F.sequence(F.lit(0), F.lit(63))
    line = lambda f: F.transform(at, lambda i: f(i).cast("double"))
    routes = own.select("label", line(lambda i: i * 0).alias("kz"), line(lambda i: F.floor(i / 8) - 4 + 0.3 * F.sin(F.col("label") + i)).alias("ky"), line(lambda i: i % 8 - 4 + 0.3 * F.cos(F.col("label") + 2 * i)).alias("kx"), line(lambda i: 1 + i % 2 * 0.5).alias("w"))
    phase = lambda i: 0.3 * (F.floor(i / 8) % 8 + F.floor(i / 64) * (i % 8) + F.col("label"))
    planes = F.sequence(F.lit(0), F.lit(255))
    maps = own.select("label", F.transform(planes, lambda i: F.cos(phase(i)) / 2).alias("re"), F.transform(planes, lambda i: F.sin(phase(i)) / 2).alias("im"))
    return (maps, ["label"]), (routes, ["label"]), 4, 64, (8, 8)


@query("b2_normal", JITTER + ", e AS (SELECT vec_id, c, s, w, y, x, re, 0.3*(y+c*x+label) - 2*pi()*(ky*(y-4)+kx*(x-4))/8 AS t FROM img JOIN k USING (label), range(4) r(c)), z AS (SELECT vec_id, c, s, sum(w*re*cos(t))/16 AS re, sum(w*re*sin(t))/16 AS im FROM e GROUP BY 1,2,3) SELECT vec_id, y, x, [[sum(w*(z.re*cos(t)+z.im*sin(t)))/16]] AS re, [[sum(w*(z.im*cos(t)-z.re*sin(t)))/16]] AS im FROM e JOIN z USING (vec_id, c, s) GROUP BY 1,2,3", "img")
def b2_normal(s, d):
    """A^H A of every image with the maps and the trajectory of its label, by the circulant form."""
    return _image(N.normal(M.tile(s, d), *_jittered(s, d), width=14))


@query("b2_recovered", "SELECT vec_id, y, x, [[re]] AS re, [[im]] AS im FROM img", "img")
def b2_recovered(s, d):
    """Every image from its own samples."""
    sides = _jittered(s, d)
    return _image(N.reconstruct(N.forward(M.tile(s, d), *sides, width=14), *sides, steps=60, width=14))


@query("b3_cg")
def b3(s, d):
    return _image(B.cg_sense(*_sides(s, d), 40, 0.05, 0.01))


@query("b3_tikhonov", "+" + MAPS + ", k AS (SELECT * FROM kspace), " + sense("k") + ", r AS (SELECT vec_id, y, x, sum(re*re+im*im) AS w FROM m GROUP BY 1,2,3) SELECT vec_id, y, x, [[re/(w+0.5)]] AS re, [[im/(w+0.5)]] AS im FROM a JOIN r USING (vec_id,y,x)", "kspace")
def b3_tikhonov(s, d):
    """With every line measured the damped least squares solution is a quotient per voxel."""
    k, maps, _ = _sides(s, d)
    return _image(B.cg_sense(k, maps, np.ones((4, 4)), 40, 0.5))


@query("b3_coupled", "+g AS (SELECT label, vec_id, y, x, re, row_number() OVER (PARTITION BY label, y, x ORDER BY vec_id) AS t, count(*) OVER (PARTITION BY label, y, x) AS n FROM img), b AS (SELECT label, y, x, f, sum(re*cos(pi()*(t-0.5)*f/n))*(CASE WHEN f=0 THEN 1.0 ELSE 2.0 END)/max(n)/(1.25+0.5*(2-2*cos(pi()*f/max(n)))) AS c FROM g JOIN (SELECT unnest(range(400))::INT AS f) r ON f<n GROUP BY 1,2,3,4) SELECT g.vec_id, g.y, g.x, [[sum(c*cos(pi()*(t-0.5)*f/n))]] AS re, 0.0::DOUBLE AS im FROM g JOIN b USING (label,y,x) GROUP BY 1,2,3", "img")
def b3_coupled(s, d):
    """The images of a label as frames: (1.25 + 0.5 D^H D) x = image over all of them at once; cosines solve it in closed form."""
    at = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    right = M.tile(s, d).withColumn("t", at).select("label", "t", "vec_id", "re", "im")
    keys = ["label", "t"]
    normal = lambda x: CC.differences(x, "t", keys, 0.5)
    x = CC.conjugate_gradients(right.drop("vec_id"), normal, keys, ["label"], 25, lam=1.25, tolerance=1e-10)
    return out(M.tiles_to_cells(x.join(right.select(*keys, "vec_id"), keys).drop(*keys), ["y", "x"], [8, 8]), *IM)


query("b4_pics")(lambda s, d: _image(B.pics(*_sides(s, d), 0.01, eigen_step=True)))


@query("b4_all_lines", "+" + MAPS + ", k AS (SELECT * FROM kspace), " + sense("k") + " SELECT vec_id, y, x, [[re*greatest(1-0.05/greatest(sqrt(re*re+im*im),1e-300),0)]] AS re, [[im*greatest(1-0.05/greatest(sqrt(re*re+im*im),1e-300),0)]] AS im FROM a", "kspace")
def b4_all_lines(s, d):
    """With every line measured and maps of unit norm the l1 solution is the threshold of the adjoint."""
    k, maps, _ = _sides(s, d)
    return _image(B.pics(k, maps, np.ones((4, 4)), 0.05, 60))


@query("b4_wavelet")
def b4_wavelet(s, d):
    """One coil of 16 x 16: the mosaic's spectrum, of which every second line is known, with a wavelet term."""
    k = T.tile_map(_mosaic(s, d), None, lambda x: K.fft(x, (1, 2), unitary=True)[:, None])
    mask = np.where((np.arange(16)[:, None] % 2 == 0) | (np.abs(np.arange(16)[:, None] - 8) <= 2), 1.0, 0.0) * np.ones((16, 16))
    return out(M.tiles_to_cells(B.pics(k, np.ones((1, 16, 16)), mask, 0.01, wavelet="dau2"), ["y", "x"]), "m", "y", "x")


@query("b5_consensus", "+" + MAPS + ", k AS (SELECT * FROM kspace), " + sense("k") + " SELECT vec_id, y, x, [[re*greatest(1-0.05/greatest(sqrt(re*re+im*im),1e-300),0)]] AS re, [[im*greatest(1-0.05/greatest(sqrt(re*re+im*im),1e-300),0)]] AS im FROM a", "kspace")
def b5_consensus(s, d):
    """With every line measured two l1 terms of the image are one of their sum."""
    k, maps, _ = _sides(s, d)
    return _image(TT.consensus(k, maps, np.ones((4, 4)), [TT.l1(0.02), TT.l1(0.03)], 1.0, 120))


@query("b5_two_terms")
def b5_two_terms(s, d):
    return _image(TT.consensus(*_sides(s, d), [TT.total_variation(0.01), TT.fourier(0.005)]))


query("b5_admm")(lambda s, d: _image(B.admm_tv(*_sides(s, d), 0.01)))
query("b5_primal_dual")(lambda s, d: _image(B.primal_dual(*_sides(s, d), 0.01, 0.005)))
query("b6_pocsense")(lambda s, d: _coil_cells(B.pocsense(*_sides(s, d), 20)))
@query("b6_measured", "SELECT vec_id, coil, y, x, [[re]] AS re, [[im]] AS im FROM kspace WHERE " + PATTERN, "kspace")
def b6_measured(s, d):
    """Measured cells after the sweeps are those of the data."""
    k = M.tiles_to_cells(B.pocsense(*_sides(s, d), 10), ["coil", "y", "x"])
    return out(k.where("y % (1 + label % 2) = 0 OR y BETWEEN 1 AND 2"), "vec_id", "coil", "y", "x")


query("b6_robust")(lambda s, d: _coil_cells(B.pocsense(*_sides(s, d), 20, 0.01, robust=0.02)))
query("b7_nlinv")(lambda s, d: _image(B.nlinv(M.kspace(s, d), (_pattern(s, d), ["label"]))))


@query("b7_coils")
def b7_coils(s, d):
    return out(M.tiles_to_cells(B.nlinv(M.kspace(s, d), (_pattern(s, d), ["label"]), coils=True), ["plane", "y", "x"]), "vec_id", "plane", "y", "x")


@query("b8_recovery", "SELECT p_partkey, round(p_retailprice,2)+0.0::DOUBLE AS m0, round(400.0+20*p_size,2)+0.0::DOUBLE AS t1 FROM part")
def b8_recovery(s, d):
    times = [50.0, 200.0, 400.0, 800.0, 1500.0, 2500.0, 4000.0, 6000.0]
    at = F.get(F.array(*map(F.lit, times)), F.col("e"))
    x = M.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("e"))
    x = x.select("p_partkey", "e", (F.col("p_retailprice") * (1 - 2 * F.exp(-at / (400.0 + 20 * F.col("p_size"))))).alias("re"))
    f = B.fit_voxels(x, "p_partkey", times, K.fit_recovery, (1.0, 900.0), ("m0", "t1"))
    return f.select("p_partkey", M.rounded("m0", 2).alias("m0"), M.rounded("t1", 2).alias("t1"))


@query("b8_mobafit", "SELECT p_partkey, round(p_retailprice,3)+0.0::DOUBLE AS m0, round(20.0+p_size,3)+0.0::DOUBLE AS t2 FROM part")
def b8(s, d):
    f = B.fit_voxels(M.echo(s, d), "p_partkey", 12.5 * np.arange(1, 9), start=None)
    return f.select("p_partkey", M.rounded("m0", 3).alias("m0"), M.rounded("t2", 3).alias("t2"))


@query("b9_log_linear", "SELECT p_partkey, [[p_retailprice]] AS m0, [[20.0+p_size]] AS t2 FROM part")
def b9(s, d):
    return out(B.log_linear(M.echo(s, d), "p_partkey", "te"), "p_partkey", values=("m0", "t2"))


@query("b10_looklocker", "SELECT l_orderkey, l_linenumber, [[CASE WHEN l_quantity<5 OR l_tax*l_discount=0 THEN 0 ELSE l_quantity/(l_tax*l_discount) END]] AS t1 FROM lineitem")
def b10(s, d):
    t1 = B.look_locker(F.col("l_tax"), F.col("l_quantity"), F.col("l_discount"), 5.0)
    return M.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", M.rounded(t1).alias("t1"))


@query("b11_subspace")
def b11(s, d):
    x = M.echo_tiles(s, d)
    _, v = T.singular_values_of_tiles(x, 8)
    p = v[:, :3] @ v[:, :3].T.conj()
    return out(M.tiles_to_cells(T.apply_to_tiles(x, p), ["v"], [8]), "p_partkey", "v", values=("re",))


query("b12_rof")(lambda s, d: _image(T.tile_map(M.tile(s, d), (8, 8), lambda x: K.rof(x, 0.05))))
query("b13_tgv")(lambda s, d: _image(T.tile_map(M.tile(s, d), (8, 8), lambda x: K.tgv(x, 0.05))))
NLMEANS = (
    "+r AS (SELECT i::INT AS i, (CASE WHEN i<0 THEN -i WHEN i>7 THEN 14-i ELSE i END)::INT AS at FROM range(-3,11) t(i)), p AS (SELECT vec_id, a.i AS y, b.i AS x, re FROM img JOIN r a ON a.at=y JOIN r b ON b.at=x), "
    "g AS (SELECT i::INT AS i, j::INT AS j, exp(-(i*i+j*j)/2.0::DOUBLE) AS g FROM range(-1,2) a(i), range(-1,2) b(j)), n AS (SELECT sqrt(sum(g*g)) AS n FROM g), q AS (SELECT y::INT AS y, x::INT AS x, u::INT AS u, v::INT AS v FROM range(8) a(y), range(8) b(x), range(-2,3) c(u), range(-2,3) e(v)), "
    "d AS (SELECT s.vec_id, q.y, q.x, q.u, q.v, sum(g*(s.re-t.re)*(s.re-t.re)) AS d FROM q, g JOIN p s ON s.y=q.y+i AND s.x=q.x+j JOIN p t ON t.vec_id=s.vec_id AND t.y=q.y+q.u+i AND t.x=q.x+q.v+j GROUP BY 1,2,3,4,5), "
    "w AS (SELECT d.*, exp(-d/(2*0.01*n)) AS w FROM d, n) SELECT w.vec_id, w.y, w.x, [[sum(w*re)/sum(w)]] AS re, 0.0::DOUBLE AS im FROM w JOIN p ON p.vec_id=w.vec_id AND p.y=w.y+u AND p.x=w.x+v GROUP BY 1,2,3"
)
query("b14_nlmeans", NLMEANS, "img")(lambda s, d: _image(T.tile_map(M.tile(s, d), (8, 8), lambda x: K.nlmeans(x, 3, 2, 0.1))))
HOMODYNE = (
    "+" + UNITARY + ", w AS (SELECT *, CASE WHEN y<2 THEN 2.0 WHEN y>=6 THEN 0.0 ELSE 1-(y-4)/2.0 END AS ramp, CASE WHEN abs(y-4)<2 THEN 1 ELSE 0 END AS low FROM f WHERE y<6), "
    "g AS (SELECT vec_id, u::INT AS y, v::INT AS x, sum(ramp*(re*cos(t)-im*sin(t)))/8 AS re, sum(ramp*(re*sin(t)+im*cos(t)))/8 AS im, sum(low*(re*cos(t)-im*sin(t))) AS lr, sum(low*(re*sin(t)+im*cos(t))) AS li FROM (SELECT w.*, u, v, 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 AS t FROM w, range(8) a(u), range(8) b(v)) GROUP BY 1,2,3) "
    "SELECT vec_id, y, x, [[(re*lr+im*li)/sqrt(lr*lr+li*li)]] AS re, 0.0::DOUBLE AS im FROM g"
)
query("b15_homodyne", HOMODYNE, "img")(lambda s, d: _image(T.tile_map(M.tile(s, d), (8, 8), lambda x: K.homodyne(K.fft(x, (1, 2), unitary=True), 0.75) + 0j)))
_PH = np.exp(0.2j * np.arange(8)[:, None] * np.ones((8, 8)))
SEGMENTS = [np.ones((8, 8)), _PH], [np.full((8, 8), 0.5), np.conj(_PH) * 0.5]


@query("b16_field_corrected", "+e AS (SELECT vec_id, l, u, v, re, 0.2*l*y - 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 - 0.2*l*u AS t FROM img, range(2) s(l), range(8) a(u), range(8) b(v)) SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t))/16]] AS re, [[sum(re*sin(t))/16]] AS im FROM e GROUP BY 1,2,3", "img")
def b16(s, d):
    return _image(B.field_corrected(M.tile(s, d), None, *SEGMENTS))


@query("b16_adjoint", "+e AS (SELECT vec_id, l, u, v, re, 0.2*l*y + 2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8 - 0.2*l*u AS t FROM img, range(2) s(l), range(8) a(u), range(8) b(v)) SELECT vec_id, u::INT AS y, v::INT AS x, [[sum(re*cos(t))/16]] AS re, [[sum(re*sin(t))/16]] AS im FROM e GROUP BY 1,2,3", "img")
def b16_adjoint(s, d):
    return _image(B.field_corrected(M.tile(s, d), None, *SEGMENTS, adjoint=True))


# streaming


def _events(s: SparkSession, d: str) -> DataFrame:
    return X.source(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_frames", "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, [[sum(value)]] AS total FROM events GROUP BY 1,2")
def x1(s, d):
    span = M.table(s, d, "events").select(F.datediff(F.max("ts"), F.min("ts")).alias("n")).first()["n"] or 0
    got = X.run(X.frames(_events(s, d), "user_id", "ts", "value", "1 day", f"{span + 1} days"), "frames", mode="update")  # nothing in the table is late
    return X.latest(got, ["user_id", "start"]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", M.rounded("total").alias("total"))


@query("x2_binned", "SELECT c_mktsegment AS segment, count(*) AS n, [[sum(value)]] AS total FROM events JOIN customer ON user_id=c_custkey GROUP BY 1")
def x2(s, d):
    labels = M.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    got = X.run(X.binned(_events(s, d), labels, "user_id", "segment", "value"), "binned", mode="update")
    return X.latest(got, ["segment"]).select("segment", "n", M.rounded("total").alias("total"))


@query("x3_damped", "+e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT a.user_id, a.event_id, round(sum(b.value*exp(-0.1::DOUBLE*(a.n-b.n))),5)+0.0::DOUBLE AS state FROM e a JOIN e b ON a.user_id=b.user_id AND b.n<=a.n GROUP BY 1,2")
def x3(s, d):
    span = M.table(s, d, "events").select(F.datediff(F.max("ts"), F.min("ts")).alias("n")).first()["n"] or 0
    events, close = X.ending(s, _events(s, d), "ts")
    got = X.run(X.damped(events, "user_id", "ts", "event_id", "value", math.exp(-0.1), f"{span + 1} days"), "damped", close=close)
    return got.select("user_id", "event_id", M.rounded("state", 5).alias("state"))


def _dealt(s: SparkSession, rows: DataFrame, order: str, batches: int, inside: bool = False) -> DataFrame:
    """A stream of a table in so many micro-batches: a file for each stretch of ``order``, and in order ``inside`` if asked for."""
    folder = f"{shared_folder(s)}/dealt-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(batches, order)
    (dealt.sortWithinPartitions(order) if inside else dealt).write.parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("x1_by_count", "+e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i FROM events) SELECT user_id, (i//8)::BIGINT AS frame, count(*) AS n, count(*)=8 AS complete, [[sum(value)]] AS total FROM e GROUP BY 1,2")
def x1_by_count(s, d):
    """Frames of eight events of a user, dealt over several micro-batches out of order; the last one of a user is cut short."""
    e = M.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select("user_id", "ts", "value", at.alias("i")).withColumn("turn", F.pmod(F.xxhash64("user_id", "i"), F.lit(1000)))
    span = e.select(F.datediff(F.max("ts"), F.min("ts")).alias("n")).first()["n"] or 0
    items, close = X.ending(s, _dealt(s, rows, "turn", 5), "ts")
    got = X.run(X.frames_by_count(items, ["user_id"], "i", "value", "ts", 8, f"{span + 1} days"), "counted", close=close)
    return got.select("user_id", "frame", "n", "complete", M.rounded("total").alias("total"))


@query("x3_images", "+t AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS f FROM embeddings), p AS (SELECT a.label, a.f, i::INT AS i, sum((2.0::DOUBLE/3)*b.embedding[i+1]*power(0.3::DOUBLE, a.f-b.f)) AS re FROM t a JOIN t b ON a.label=b.label AND b.f<=a.f, range(64) r(i) GROUP BY 1,2,3) SELECT label::BIGINT AS label, f::BIGINT AS frame, (i//8)::INT AS y, (i%8)::INT AS x, [[re]] AS re, 0.0::DOUBLE AS im FROM p")
def x3_images(s, d):
    """The images of a label as frames of a slice: argmin |x - y|^2 + |x - 0.9 last|^2 / 2, so x = (2 y + 0.9 last) / 3."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = M.tile(s, d).withColumn("frame", at.cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame")))
    rows = rows.withColumn("turn", F.col("frame") + F.pmod(F.col("frame"), F.lit(7)) * 3).select("label", "frame", "ts", "re", "im", "turn")
    batches = max(4, -(-M.table(s, d, "embeddings").count() // 50_000))  # a micro-batch has 50,000 images, however many there are
    got = X.run(X.damped_images(_dealt(s, rows, "turn", batches, inside=True), "label", "frame", "ts", "1 day", lambda y, prior: (2 * y + prior) / 3), "images")
    return out(M.tiles_to_cells(got.select("label", "frame", "re", "im"), ["y", "x"], [8, 8]), "label", "frame", "y", "x")


@query("x4_tee", "SELECT event_id, event_type='click' AS kept, [[value]] AS value FROM events")
def x4(s, d):
    rest = f"{shared_folder(s)}/rest-{uuid.uuid4().hex}"
    kept = X.run(_events(s, d), "tee", X.tee(rest, "event_type = 'click'"))
    other = s.read.parquet(rest).drop("micro_batch")
    return kept.withColumn("kept", F.lit(True)).drop("batch").unionByName(other.withColumn("kept", F.lit(False))).select("event_id", "kept", M.rounded("value").alias("value"))


# user functions
@query("u1_linear_operator", "SELECT vec_id, 0.0::DOUBLE AS gap FROM embeddings")
def u1(s, d):
    adj = lambda y: K.fft(y, (1, 2), inverse=True)
    return out(B.dot_test(M.tile(s, d), (8, 8), lambda x: K.fft(x, (1, 2)), adj), "vec_id", values=("gap",))


@query("u2_model", "SELECT p_partkey, round(p_retailprice,2)+0.0::DOUBLE AS m0, round(1.0/(20.0+p_size),4)+0.0::DOUBLE AS r2 FROM part")
def u2(s, d):
    fit = B.gauss_newton(lambda t, p: p[:, :1] * np.exp(-t * p[:, 1:]), lambda t, p: np.stack([np.exp(-t * p[:, 1:]), -p[:, :1] * t * np.exp(-t * p[:, 1:])], 2), 20)
    f = B.fit_voxels(M.echo(s, d), "p_partkey", 12.5 * np.arange(1, 9), fit, (1.0, 0.02), ("m0", "r2"))
    return f.select("p_partkey", M.rounded("m0", 2).alias("m0"), M.rounded("r2", 4).alias("r2"))


@query("u1_registry", "SELECT vec_id, y, x, [[2*re]] AS re, [[2*im]] AS im FROM img", "img")
def u1_registry(s, d):
    known = B.Registry()
    known.add("twice", forward=lambda x: 2 * x, adjoint=lambda y: 2 * y)
    return _image(known.apply("twice", M.tile(s, d), None))


query("u3_denoiser_prior")(lambda s, d: _image(B.pics(*_sides(s, d), 0.0, 15, lambda x, rate: K.rof(x, 0.01 * rate, 10))))


@query("flow_sense", "+" + MAPS + SAMPLED + ", " + sense("k") + ", f AS (SELECT vec_id, y, x, sqrt(sum(re*re+im*im)) AS r FROM ff GROUP BY 1,2,3), p AS (SELECT a.vec_id, sqrt(a.re*a.re+a.im*a.im) AS v, r FROM a JOIN f USING (vec_id,y,x)), q AS (SELECT vec_id, sqrt(greatest(sum(v*v)-sum(v*r)*sum(v*r)/sum(r*r),0)/(sum(v*r)*sum(v*r)/sum(r*r))) AS e FROM p GROUP BY 1) SELECT label, count(*)::DOUBLE AS count, [[avg(e)]] AS mean, [[max(e)]] AS worst FROM q JOIN embeddings USING (vec_id) GROUP BY 1".replace(", f AS", ", " + IDFT.format("kspace").replace("i AS", "ff AS", 1) + ", f AS", 1), "kspace")
def flow_sense(s, d):
    """Pattern of each label, maps from each item's own centre, SENSE, and its scaled error from the root of sums of squares of all data, by label."""
    image = M.tiles_to_cells(B.sense_adjoint(*_sides(s, d)), ["y", "x"]).withColumns({"re": E.modulus(), "im": F.lit(0.0)})
    full = M.tiles_to_cells(T.tile_map(M.kspace(s, d), None, lambda y: K.fft(y, (2, 3), inverse=True, unitary=True)), ["coil", "y", "x"])
    e = A.nrmse(image, A.rss(full, ["vec_id", "y", "x"]), ["vec_id", "y", "x"], ["vec_id"], True)
    by = e.join(M.table(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label")
    return out(by.agg(F.count("*").cast("double").alias("count"), F.avg("nrmse").alias("mean"), F.max("nrmse").alias("worst")), "label", values=("count", "mean", "worst"))


def _decay_basis(s: SparkSession, d: str, rank: int) -> np.ndarray:
    """Leading vectors (vector, echo) of the decays of all T2 values of the table."""
    values = M.table(s, d, "part").select("p_size").distinct().withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(7))))
    re = F.exp(-12.5 * (F.col("e") + 1) / (20.0 + F.col("p_size")))
    cells = values.select("p_size", "e", re.alias("re"), F.lit(0.0).alias("im"))
    return T.singular_values(cells, "p_size", "e", 8)[1][:, :rank].real.T


def _subspace_coefficients(s: SparkSession, d: str, basis: np.ndarray) -> DataFrame:
    """Coefficient images (a, y, x) of slices of sixteen parts, whose eight frames are echoes and lack one line of their spectrum each.

    Blocks are 2 x 2, so an image has four.  The penalty takes the last singular value of 55 % of the blocks of sf 0.1, and
    the steps are enough for that.
    """
    own, at = F.floor((F.col("p_partkey") - 1) / 16), F.pmod(F.col("p_partkey") - 1, F.lit(16)).cast("int")
    x = M.echo(s, d).select(own.alias("slice"), (F.col("e") - 1).alias("t"), F.floor(at / 4).cast("int").alias("y"), (at % 4).alias("x"), "re", "im")
    frames = M.cells_to_tiles(x, ["slice"], ["t", "y", "x"], [8, 4, 4])
    mask = np.stack([np.repeat((np.arange(4) % 4 != t % 4).astype(float)[:, None], 4, 1) for t in range(8)])
    maps, size = np.ones((1, 4, 4)), (8, 1, 4, 4)
    k = T.tile_map(frames, (8, 4, 4), lambda v: (mask * K.fft(v, (2, 3), unitary=True))[:, :, None])
    scale = A.data_scaling(M.tiles_to_cells(B.subspace_adjoint(k, size, maps, mask, basis), ["a", "y", "x"]), ["slice"])
    by = lambda c, f: F.transform(c, lambda v: f(v, F.col("scale")))
    scaled = k.join(scale, "slice").withColumns({c: by(c, lambda v, n: v / n) for c in ("re", "im")})
    return TT.subspace_consensus(scaled.drop("scale"), size, maps, mask, basis, [TT.low_rank(1e-4, 2)], 0.1, 60, 10)


@query("flow_subspace_map", "SELECT p_size % 5 AS region, count(*) AS n, [[median(20.0+p_size)]] AS t2 FROM part GROUP BY 1")
def flow_subspace_map(s, d):
    """Basis from a dictionary, scale from the adjoint, coefficients under block low rank from incomplete frames, match, medians by region."""
    basis = _decay_basis(s, d, 4)
    coefficients = _subspace_coefficients(s, d, basis)
    series = T.tile_map(coefficients, (4, 4, 4), lambda c: np.einsum("at,bayx->byxt", basis, c))
    cells = M.tiles_to_cells(series, ["y", "x", "frame"]).select((F.col("slice") * 16 + F.col("y") * 4 + F.col("x") + 1).alias("p_partkey"), "frame", "re", "im")
    parts = M.table(s, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("region")).hint("merge")  # two narrow columns look small in their file, but there are as many rows as voxels
    t2 = np.arange(21, 71)
    match = T.dictionary_match(cells.join(parts.select("p_partkey"), "p_partkey"), "p_partkey", "frame", np.exp(-12.5 * np.arange(1, 9) / t2[:, None]))
    return match.join(parts, "p_partkey").groupBy("region").agg(F.count("*").alias("n"), F.median(F.col("atom") + 21).alias("t2")).select("region", "n", M.rounded("t2").alias("t2"))


@query("flow_voxel_fit", "SELECT p_size % 5 AS region, count(*)::DOUBLE AS count, [[avg(20.0+p_size)]] AS mean, [[stddev_pop(20.0+p_size)]] AS std FROM part GROUP BY 1")
def flow_voxel_fit(s, d):
    """Straight line through the logarithms, then statistics of T2 by region."""
    fit = B.log_linear(M.echo(s, d), "p_partkey", "te").join(M.table(s, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("region")), "p_partkey")
    stat = A.region_statistics(fit.select("region", F.col("t2").alias("re"), F.lit(0.0).alias("im")), "region")
    return out(stat, "region", values=("count", "mean", "std"))


@query("flow_coil_image", "+k AS (SELECT vec_id, label, u, v, sum(re*cos(2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8))/8 AS re, sum(re*sin(2*pi()*((u-4)*(y-4)+(v-4)*(x-4))/8))/8 AS im FROM img, range(8) a(u), range(8) b(v) GROUP BY 1,2,3,4), m AS (SELECT label, u, v, sqrt(sum(re*re+im*im)) AS re FROM k GROUP BY 1,2,3) SELECT label, count(*)::DOUBLE AS count, [[avg(re)]] AS mean, [[stddev_pop(re)]] AS std FROM m GROUP BY 1", "img")
def flow(s, d):
    """Unitary inverse transform of every tile, root of sums of squares over a label's tiles, statistics by label."""
    im = M.tiles_to_cells(T.fft(M.tile(s, d), (8, 8), inverse=True, unitary=True), ["y", "x"], [8, 8])
    return out(A.region_statistics(A.rss(im, ["label", "y", "x"]), "label"), "label", values=("count", "mean", "std"))
