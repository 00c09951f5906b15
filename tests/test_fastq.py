import pytest

from repspark.sources.raw import read_fastq


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_third_lines_that_repeat_the_id_and_carriage_returns(spark, tmp_path):
    p = tmp_path / "r.fastq"
    p.write_bytes(b"@SRR1.1 x\nACGT\n+SRR1.1 x\n@III\n@b\r\nTT\r\n+\r\nII\r\n@c\nGG\n+\n+\n@d\n\n+\n\n\n\n")
    assert values(read_fastq(spark, str(p))) == [("r", "SRR1.1 x", "ACGT"), ("r", "b", "TT"), ("r", "c", "GG"), ("r", "d", "")]


def test_files_of_many_splits(spark, tmp_path):
    want = []
    for f in ("one", "two"):
        with (tmp_path / f"{f}.fastq").open("w") as out:
            for i in range(3000):
                s = "ACGT"[i % 4] * (i % 37 + 1)
                out.write(f"@{f}{i}\n{s}\n+{f if i % 2 else ''}\n{'@' * len(s)}\n")
                want.append((f, f"{f}{i}", s))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        assert values(read_fastq(spark, str(tmp_path))) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_of_more_than_four_lines_raise(spark, tmp_path):
    p = tmp_path / "w.fastq"
    p.write_text("@a\nAC\nGT\n+\nII\nII\n@b\nTT\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ header at line 5"):
        read_fastq(spark, str(p)).collect()
