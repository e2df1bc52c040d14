from pyspark.sql import functions as F

from tessera.plans import logs
from tessera.sources import runs


def test_names(spark):
    names = [
        "/d/keeneland-runs/set.separate.keeneland.n32.f9600.MPI_AMR.b4.io60-1.is60.ost", "/d/x.kfs.1/set-sep.p512.f-1.POSIX.b2.io-1.is-1.data2048.nb",
        "/d/y-compressed1/set.coloc.keeneland.n60.f18000.MPI_LUSTRE.b4.is-1-MPI_LUSTRE", " set.baseline.jaguar.push.n2.f7 ", "/d/z-syntest/a.p10.f3.NULL.b1.io4.is2.data512.b", "notes.txt", "", None,
    ]
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "i int, file string, sys_ string")
    got = {r.i: r for r in runs.name_parameters(df, "file").collect()}
    a, b, c, d, e = (got[i] for i in range(5))
    assert (a.type, a.layout, a.sys, a.n_procs, a.n_master, a.n_compute, a.n_io, a.n_files, a.transport, a.buffer_size, a.io_group_size, a.data_size, a.blocking, a.compressed, a.striped) == (
        "TCGA", "separate", "keeneland", 384, 1, 323, 60, 9600, "MPI_AMR", 4, None, 4096, "b", False, True)
    assert (b.layout, b.sys, b.n_procs, b.n_compute, b.n_io, b.n_files, b.io_group_size, b.data_size, b.blocking) == ("separate", "kfs", 512, 511, None, -1, None, 2048, "nb")
    assert (c.layout, c.transport, c.buffer_size, c.io_group_size, c.compressed, c.n_compute) == ("coloc", "MPI_LUSTRE", 4, None, True, 719)
    assert (d.layout, d.sys, d.n_master, d.n_procs, d.n_compute, d.transport) == ("baseline", "jaguar", 0, 24, 24, "opencv")
    assert (e.type, e.n_io, e.io_group_size, e.data_size, e.blocking, e.n_compute) == ("synth", 4, 2, 512, "b", 5)
    assert all(got[i].n_procs is None and got[i].type is None and got[i].sys_ == "kept" for i in (5, 6, 7))


def test_stamps_and_logs(spark, tmp_path):
    run = "Mon Mar  4 05:06:07 EST 2013\nmpirun -n 4 ./a.exe in out\nRecognized Options:\n  size: 4\n  size: 5\n  name : a:b\ndir to create: x\nok\n"
    (tmp_path / "job.o123").write_text("head\nTue Mar  5 00:00:00 EST 2013\nno command\n" + run + run.replace(" 4 05", "14 15") + "zzz\nsome error here\nend\n")
    (tmp_path / "job.o124").write_text("nothing ran\n")
    (tmp_path / "job.o125").write_text("")
    (tmp_path / "other.csv").write_text(run)
    logs = runs.read_consoles(spark, str(tmp_path))
    assert logs.count() == 2
    first, second = runs.scrape(logs).orderBy("run").collect()
    assert (str(first.start), str(first.finish), first.status, first.launcher, first.program, first.arguments, first.options) == (
        "2013-03-04 05:06:07", "2013-03-14 15:06:07", None, "mpirun", "./a.exe", "in out", {"size": "5", "name": "a:b"})
    assert (second.run, second.status, second.finish) == (1, "OTHER FAILURE", None)
    assert runs.scrape(logs.limit(0)).count() == 0
    odd = spark.createDataFrame([("a", None, None), ("b", "", None), ("c", run, None)], "log string, text string, ended timestamp")
    assert [(r.log, r.finish) for r in runs.scrape(odd).collect()] == [("c", None)]
    times = spark.createDataFrame([("Sat Nov 28 07:24:00 2026",), ("soon",), (None,)], "t string").select(runs.stamp(F.col("t")).cast("string").alias("s")).collect()
    assert [t.s for t in times] == ["2026-11-28 07:24:00", None, None]


def test_stage_outcomes(spark):
    stages = ["toRGB", "background", "RBC", "GrayNU", "NuMask", "removeRBC", "separateNuclei", "finalCleanup"]
    rows, t = [], 0
    for pid, of in enumerate([stages, stages[:6], stages[:2], stages[:4], ["toRGB", "finalCleanup"]]):
        for name in [*of, *stages[:2]]:
            rows.append((t, pid, name, t * 10 + 1, t * 10 + 5))
            t += 1
    log = spark.createDataFrame(rows, "seq long, pid int, eventName string, startT long, endT long")
    got = logs.stage_outcome(logs.collapse_runs(log, F.col("eventName") == "toRGB")).orderBy("startT").collect()
    assert [r.outcome for r in got] == ["computeFull", "computeNoFG", "computeNoNU", "computeNoFG", "computeNoFG", "computeNoFG", None, "computeNoFG", None, "computeNoFG"]
    assert (got[0].startT, got[0].endT) == (1, 75)
