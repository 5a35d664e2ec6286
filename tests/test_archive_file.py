from hypothesis import given
from hypothesis import strategies as st

from stratafold.sources import archive_file as R

FILES = [("storing", [("a", "x.txt", 1700000000, b"hello"), ("a/b", "empty", 5, b"")]), ("delta+tor", [("", "big.bin", 9, bytes(range(256)) * 40), ("a", "y.txt", 7, b"why")])]


@given(st.integers(0, 2**64 - 1))
def test_whole_numbers(v):
    o = R._Octets(R.whole_number(v))
    assert o.whole() == v and not o.left()


def test_archives_as_tables(spark, tmp_path):
    R.register(spark)
    good = R.pack(FILES, comment="a note", locked=True, prefix=b"stub program")
    (tmp_path / "good.arc").write_bytes(good)
    read = lambda table, mode="permissive": spark.read.format("solid_archive").option("table", table).option("mode", mode).load(str(tmp_path / "*.arc"))
    files = read("files").orderBy("file_id").collect()
    assert [(r.dir, r.name, r.size, r.block, r.compressor) for r in files] == [
        ("a", "x.txt", 5, 0, "storing"), ("a/b", "empty", 0, 0, "storing"), ("", "big.bin", 10240, 1, "delta+tor"), ("a", "y.txt", 3, 1, "delta+tor"),
    ]
    whole = {r.name: bytes(r.content) for r in read("contents").where("intact").collect()}
    assert whole == {x[1]: x[3] for _, part in FILES for x in part}
    top = read("archives").first()
    assert (top.locked, top.comment, top.error) == (True, "a note", None)
    data = read("blocks").where("type = 2").orderBy("pos").collect()
    assert data[0].pos == len(b"stub program") and [r.n_files for r in data] == [2, 2]
    # damage: no footer, a changed descriptor, a changed footer
    (tmp_path / "cut.arc").write_bytes(b"no archive")
    (tmp_path / "descr.arc").write_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    at = good.rfind(b"a note")
    (tmp_path / "foot.arc").write_bytes(good[:at] + b"b" + good[at + 1 :])
    errors = {r.archive.rsplit("/", 1)[1]: r.error for r in read("archives").collect()}
    assert errors == {"good.arc": None, "cut.arc": "no_footer", "descr.arc": "descriptor_crc", "foot.arc": "block_crc"}
    assert read("files").count() == 4


def test_a_changed_file_is_not_intact(tmp_path):
    good = R.pack(FILES)
    (tmp_path / "x.arc").write_bytes(good.replace(b"hello", b"jello", 1))
    got = {r[3]: r[6] for r in R.rows(str(tmp_path / "x.arc"), "contents", True)}
    assert got == {"x.txt": False, "empty": True, "big.bin": True, "y.txt": True}
