"""Log files of every version, and the same logs as streams."""

from pyspark.sql import functions as F

from tessera.plans import logs
from tessera.sources import eventlog
from tessera.streaming import logs as stream

V21 = """v2.1,logger start,2012/12/12 17:48:33,logger finish,2012/12/12 17:48:49

# a comment
pid,0,hostName,n1,group,1,sessionName,seg,read,31,11,20,1048576,computeFull,0,21,420,,
pid,1,hostName,n1,group,0,sessionName,io,write,32,400,900,4096
pid,2,hostName,n2,group,0,sessionName,io,
pid,3,hostName,n2,group,0,sessionName,io,other,-1,5,6,
"""
V1 = "pid,4,hostName,n3,sessionName,seg,read,31,1,10,scan,0,11,30,\n"
V2 = "v2,start\npid,5,hostName,n3,sessionName,seg,read,31,1,10,77,\n"


def test_versions(spark, tmp_path):
    for name, text in (("a", V21), ("b", V1), ("c", V2), ("d", V21.replace("v2.1", "v2.2")), ("e", "")):
        (tmp_path / name).write_text(text)
    got = {(r.pid, r.seq): (r.hostName, r.grp, r.sessionName, r.eventName, r.eventType, r.startT, r.endT, r.attribute) for r in eventlog.read(spark, str(tmp_path)).collect()}
    assert got == {
        (0, 0): ("n1", 1, "seg", "read", 31, 11, 20, 1048576), (0, 1): ("n1", 1, "seg", "computeFull", 0, 21, 420, 0),
        (1, 0): ("n1", 0, "io", "write", 32, 400, 900, 4096), (3, 0): ("n2", 0, "io", "other", -1, 5, 6, 0),
        (4, 0): ("n3", None, "seg", "read", 31, 1, 10, 0), (4, 1): ("n3", None, "seg", "scan", 0, 11, 30, 0), (5, 0): ("n3", None, "seg", "read", 31, 1, 10, 77),
    }


def test_stream_agrees_with_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text(V21)
    batch = eventlog.parse_lines(spark.read.text(str(tmp_path / "in")), "v2.1")
    live = eventlog.read_stream(spark, str(tmp_path / "in"))
    for name, frame in (("rate", stream.resample(live, 200)), ("total", stream.running_totals(live))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {(r.eventType, r.bucket): r.value for r in logs.resample(batch, 200).collect()}
    rate = spark.table("rate").withColumn("bucket", F.unix_micros("start") / 200 + 1)
    assert {(r.eventType, r.bucket): r.value for r in rate.collect()} == want
    assert {(r.sessionName, r.eventName): (r.n, r.data) for r in spark.table("total").collect()} == {("seg", "read"): (1, 1048576), ("seg", "computeFull"): (1, 0), ("io", "write"): (1, 4096), ("io", "other"): (1, 0)}


def test_status_of_a_run(spark):
    texts = {"all fine": None, "MPICH2 error here": "MPI ERROR", "x exit signal Aborted": "Aborted", "Time EXCEEDED": "> 9:00", "a\nopen fail\n": "OTHER FAILURE"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in df.select("t", logs.run_status(F.col("t"), "9:00").alias("s")).collect()} == texts
