"""Large files read by byte ranges give the rows of a whole-file read."""

import random
import re

import pytest

from recallspark.sources import conversations as CV, lines as L, references as RF


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_in_order(spark, tmp_path, small_ranges):
    rng, want = random.Random(4), []
    for name in ("Chat de WhatsApp con Ana B.txt", "otro.txt", "vacio.txt"):
        own = ["" if rng.random() < 0.1 else "ñ" * rng.randint(0, 300) + str(i) for i in range(0 if name == "vacio.txt" else 2000)]
        (tmp_path / name).write_bytes("".join(line + rng.choice(["\n", "\r\n", "\r"]) for line in own).replace("\r\n", "\n").encode())
        chat = re.sub(r"^Chat de WhatsApp con |\.txt$", "", name)
        text = (tmp_path / name).read_bytes().decode()
        whole = re.split(r"\r\n|[\n\r]", text)[:-1] if text else []
        want += [(chat, k, line) for k, line in enumerate(whole)]
    read = CV.scan_chat(spark, str(tmp_path))
    assert L._placed(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((r.chat, r.seq, r.line) for r in read.collect()) == sorted(want)


def test_bibtex_by_ranges(spark, tmp_path, small_ranges):
    rng, text = random.Random(5), "preface\n"
    for k in range(3000):
        text += f"@article{{k{k},\n  title = {{T {k} {'x ' * rng.randint(0, 60)}}},\n  year={{19{k % 90 + 10}}}\n}}" + rng.choice(["\n", "\n\n", "  "])
        if k % 50 == 0:
            text += "@misc{\n  m%d, title = {start over two lines}}\n" % k
    path = str(tmp_path / "lib.bib")
    (tmp_path / "lib.bib").write_text(text)
    whole = RF.scan_bibtex(spark.createDataFrame([(path, text)], "id string, text string"))
    key = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert key(RF.scan_library(spark, path, "bib")) == key(whole) and whole.count() == 3060
