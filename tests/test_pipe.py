import pytest

import varlake as v


def sites(spark, n=90):
    rows = [("1", i * 10, i * 10 + 1, "A", ["C"], f"k{i}") for i in range(n)]
    kind = "contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, id string"
    return spark.createDataFrame(rows, kind).repartition(3)


def awk(program):
    return ["awk", "-F", "\t", program]


KEY = "split(text, '\t')[0]"


def test_every_line_once(spark, tmp_path):
    done = v.pipe_resumable(sites(spark), awk('!/^#/ { print $3 "\t" $2 }'), str(tmp_path / "p"), KEY, parts=7, parts_at_once=3)
    assert sorted((r.key, r.text) for r in done.collect()) == sorted((f"k{i}", f"k{i}\t{i * 10 + 1}") for i in range(90))


@pytest.mark.parametrize(
    "program, said",
    [
        ('!/^#/ { if ($3 != "k13") print $3 }', "'n_out': 0"),
        ('!/^#/ { print $3; if ($3 == "k7") print $3 }', "'n_out': 2"),
        ('!/^#/ { print $3; if ($3 == "k7") print "strange" }', "'n_in': 0"),
    ],
)
def test_lost_doubled_and_unknown_lines_are_found(spark, tmp_path, program, said):
    path = str(tmp_path / "p")
    with pytest.raises(ValueError, match=said):
        v.pipe_resumable(sites(spark), awk(program), path, KEY, parts=5)
    assert v.pipe_report(spark, path, KEY).count() == 1


def test_several_lines_may_be_allowed(spark, tmp_path):
    done = v.pipe_resumable(sites(spark), awk("!/^#/ { print $3; print $3 }"), str(tmp_path / "p"), KEY, parts=5, lines_each="some")
    assert done.count() == 180


def test_finished_parts_are_not_run_again(spark, tmp_path):
    """The command dies at one key until a file is there; every start leaves a file."""
    path, runs, cure = tmp_path / "p", tmp_path / "runs", tmp_path / "cure"
    runs.mkdir()
    script = tmp_path / "command.sh"
    script.write_text(
        f'touch "{runs}/$$-$(date +%s%N)"\n'
        f'awk -F "\\t" -v cured="$(test -e {cure} && echo 1)" \'!/^#/ {{ if ($3 == "k33" && !cured) exit 3; print $3 }}\'\n'
    )
    command = ["sh", str(script)]
    with pytest.raises(Exception, match="exit code 3"):
        v.pipe_resumable(sites(spark), command, str(path), KEY, parts=6, parts_at_once=1)
    parts = {r["part"] for r in spark.read.parquet(f"{path}/input").select("part").collect()}
    bad = spark.read.parquet(f"{path}/input").where("key = 'k33'").first()["part"]
    assert (path / "manifest").exists() == (bad > min(parts))
    before = len(list(runs.iterdir()))
    cure.touch()
    done = v.pipe_resumable(sites(spark), command, str(path), KEY, parts=6, parts_at_once=1)
    assert sorted(r.key for r in done.collect()) == sorted(f"k{i}" for i in range(90))
    assert len(list(runs.iterdir())) - before == len([part for part in parts if part >= bad])
    again = len(list(runs.iterdir()))
    assert v.pipe_resumable(sites(spark), command, str(path), KEY, parts=6).count() == 90 and len(list(runs.iterdir())) == again
