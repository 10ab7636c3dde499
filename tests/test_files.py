"""Directory trees as catalogs, and bundles as files."""

import os

import pytest

from sheafwork import assemble, file_catalog, file_contents, write_bundles
from sheafwork.functions.text import NOT_UTF8
from sheafwork.sources import files, sinks

GONE = "No such file or directory (os error 2)"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ro ot"
    (root / "sub" / "deep" / ".hid").mkdir(parents=True)
    (root / "one.txt").write_text("eins\n")
    (root / "sub" / "deep" / "zwei.py").write_text("zweí = 2")
    (root / "sub" / "deep" / ".hid" / "x").write_text("in")
    (root / "sub" / "bad.bin").write_bytes(b"\xff\xfe")
    (root / "sub" / "empty").write_text("")
    (root / "_under").write_text("x")
    (root / "no files").mkdir()
    (root / "dead").symlink_to(root / "nowhere")
    (root / "alias").symlink_to(root / "one.txt")
    (root / "again").symlink_to(root / "sub" / "deep")
    (root / "sub" / "back").symlink_to(root / "sub")
    os.mkfifo(root / "pipe")
    return root


def walked(root):
    """Files by ``os.walk``, with links followed but for the one that leads back."""
    out = set()
    for folder, folders, names in os.walk(root, followlinks=True):
        if "back" in folders:
            folders.remove("back")
        out |= {os.path.relpath(os.path.join(folder, n), root) for n in names}
    return out


def test_listing_equals_a_walk(spark, tree):
    for root in (str(tree), f"file:{tree}".replace(" ", "%20"), f"{tree}/"):
        found = {r.path: r for r in file_catalog(spark, root).collect()}
        assert set(found) == walked(tree) - {"pipe"} | {"sub/back"}
    assert found["dead"].read_error == GONE and found["dead"].n_bytes is None
    assert found["sub/back"].read_error == files.LINK_LOOP
    assert (found["alias"].canonical_key, found["again/zwei.py"].canonical_key) == ("one.txt", "sub/deep/zwei.py")
    assert (found["sub/empty"].n_bytes, found["sub/deep/zwei.py"].n_bytes) == (0, 9)
    assert found["sub/deep/zwei.py"].ext == "py" and found["sub/deep/.hid/x"].ext == ""


def test_listing_of_nothing(spark, tmp_path):
    assert file_catalog(spark, str(tmp_path)).count() == 0
    missing = file_catalog(spark, str(tmp_path / "missing")).collect()
    assert [(r.path, r.read_error) for r in missing] == [("", GONE)]


def test_a_folder_of_many_files_and_bad_names(spark, tmp_path):
    for k in range(files.BATCH_ROWS + 5):
        (tmp_path / f"{k}.t").touch()
    os.close(os.open(os.fsencode(tmp_path) + b"/bad\xff", os.O_CREAT))
    found = file_catalog(spark, str(tmp_path))
    assert found.where("n_bytes = 0").count() == files.BATCH_ROWS + 5
    assert [r.path for r in found.where("read_error is not null").collect()] == ["bad�"]


def test_contents_of_every_entry(spark, tree):
    for read_bytes in (1, files.READ_BYTES):
        listed = file_catalog(spark, str(tree))
        found = {r.path: (r.content, r.read_error) for r in files.read_contents(listed, str(tree), read_bytes).collect()}
        assert len(found) == listed.count()
        assert found["one.txt"] == found["alias"] == ("eins\n", None)
        assert found["sub/empty"] == ("", None) and found["sub/deep/.hid/x"] == ("in", None)
        assert found["sub/bad.bin"] == (None, NOT_UTF8) and found["dead"] == (None, GONE)
    listed = files.materialize(listed, "listed")
    (tree / "one.txt").unlink()
    found = {r.path: (r.content, r.read_error) for r in files.read_contents(listed, str(tree)).collect()}
    assert found["one.txt"] == found["alias"] == (None, GONE)


def test_unreadable_files_are_blocks(spark, tree, requests_of):
    made = assemble(requests_of(["one.txt", "sub/bad.bin", "alias"]), file_contents(spark, str(tree)))
    assert "".join(r.markdown for r in made.parts().orderBy("part_no").collect()) == (
        "one.txt\n```txt\neins\n```\n\n"
        'sub/bad.bin\n```bin\nError: Could not read file content for "sub/bad.bin".\n'
        f"Details: {NOT_UTF8}\n```\n\n"
    )


@pytest.fixture
def parts(spark):
    rows = [(r, p, f"# {r}\n{'é' * p}\n\n") for r in (3, -4, 10**12) for p in range(12)] + [(5, 0, ""), (6, 0, None)]
    return spark.createDataFrame(rows, "request_id bigint, part_no bigint, markdown string")


def texts(frame):
    return sorted((r.request_id, r.part_no, r.markdown or "") for r in frame.collect())


def test_bundles_as_files(spark, parts, tmp_path):
    root = str(tmp_path / "out")
    write_bundles(parts, root, "files")
    back = sinks.read_files(spark, root)
    assert texts(back) == texts(parts) and back.where("read_error is not null").count() == 0
    assert (tmp_path / "out" / sinks.part_name(-4, 11)).read_text() == "# -4\n" + "é" * 11 + "\n\n"
    with pytest.raises(FileExistsError):
        write_bundles(parts, root, "files")
    with pytest.raises(ValueError, match="not on a mounted"):
        write_bundles(parts, "s3://bucket/out", "files")
    (tmp_path / "out" / sinks.part_name(3, 1)).write_text("other")
    (tmp_path / "out" / sinks.part_name(3, 2)).unlink()
    faults = {(r.request_id, r.part_no): r.read_error for r in sinks.read_files(spark, root).collect() if r.read_error}
    assert faults == {(3, 1): "bytes differ from the manifest", (3, 2): GONE}


def test_a_failed_write_leaves_no_bundle(spark, parts, tmp_path):
    """A task that fails half way: no manifest; the next run ends with the same files and no others."""
    root = tmp_path / "out"
    root.mkdir()
    (root / "3").write_text("in the way of the folder of request 3")
    with pytest.raises(Exception, match="NotADirectory|FileExists"):
        sinks.write_files(parts.repartition(4), str(root))
    assert not (root / sinks.MANIFEST / "_SUCCESS").exists()
    assert not list(root.rglob("*.draft"))
    (root / "3").unlink()
    (root / "77").mkdir()
    (root / "77" / "00000000.md").write_text("left by another run")
    (root / "77" / f".{'0' * 32}.draft").write_text("half")
    (root / "notes.md").write_text("mine")
    manifest = sinks.write_files(parts, str(root))
    assert texts(sinks.read_files(spark, str(root))) == texts(parts)
    kept = {os.path.relpath(p, root) for p in root.rglob("*.md")}
    assert kept == {r.path for r in manifest.collect()} | {"notes.md"}
    assert not list(root.rglob(".*.draft"))


def test_the_bundles_are_assembled_once(spark, parts, tmp_path):
    """The rows are counted while they are computed: finding the ranges must not compute them again."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = parts.mapInArrow(count, parts.schema)
    write_bundles(counted, str(tmp_path / "once"), "json")
    assert seen.value == parts.count() == spark.read.json(str(tmp_path / "once")).select(F.count("*")).first()[0]
