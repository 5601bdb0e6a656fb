"""Shell-command rules on lines of any length and order."""

from pyspark.sql import functions as F

from tracewell.functions import commands as C


def test_risks(spark):
    rows = [
        ('echo "DROP TABLE t" | psql', "sql-drop"), ('psql -c "drop table t"', "sql-drop"), ("echo drop table t", None), ("psql -l", None),
        ("git --no-pager push --force", "force-push"), ("git -C /x --git-dir /y push -f origin", "force-push"), ("git --no-pager log --force", None), ("git push", None), ("git -c a=b reset --hard", "hard-reset"),
    ]
    got = spark.createDataFrame(rows, "c string, want string").select("c", "want", C.risky_reason(F.col("c")).alias("got")).collect()
    assert [(r.c, r.got) for r in got] == rows


def test_long_lines(spark):
    long = "pytest " + "-k name " * 60 + "tests"
    df = spark.createDataFrame([(long,)], "c string")
    path = "cat " + "d/" * 600 + "f.txt"
    row = df.select(C.check_command(F.col("c")), C.doing_command(F.col("c")), C.doing_command(F.col("c"), 20), C.check_command(F.col("c"), 240), C.shell_read(F.lit(path))["file"]).first()
    assert row[0] == long and row[1] == long and row[2] == long[:20] and row[3] is None and row[4] == path[4:]
