import zlib

from pitchside.operators.catalog import crop_plan, report_catalog, with_page_counts
from pitchside.sources import list_reports, read_page_counts
from pitchside.sources.pdf import page_counter


def _plain(n, extra=b""):
    kids = b" ".join(b"%d 0 R" % (i + 3) for i in range(n))
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] /Count " + str(n).encode() + b" >>\nendobj\n"
    for i in range(n):
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>\nendobj\n" % (i + 3)
    return out + extra + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"


def _packed(n):
    """Page tree inside a compressed object stream, with a node below the root."""
    bodies = [b"<</Type/Pages/Kids[8 0 R]/Count %d>>" % n, b"<</Type/Pages/Parent 7 0 R/Count %d>>" % n] + [b"<</Type/Page/Parent 8 0 R>>"] * n
    head, at = b"", 0
    for i, b in enumerate(bodies):
        head += b"%d %d " % (7 + i, at)
        at += len(b) + 1
    data = zlib.compress(head + b" ".join(bodies) + b" ")
    return b"%%PDF-1.5\n4 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(bodies), len(head), len(data)) + data + b"\nendstream\nendobj\n%%EOF"


def test_counts_of_single_files():
    count = page_counter()
    assert count(_plain(24)) == 24 and count(_packed(26)) == 26
    # a later version of the tree replaces the first; text inside a stream does not count
    update = b"2 0 obj\n<< /Type /Pages /Kids [] /Count 31 >>\nendobj\n9 0 obj\n<< /Length 9 >>\nstream\n/Type /Pages /Count 99\nendstream\nendobj\n"
    assert count(_plain(3, update)) == 31
    no_root = b"%PDF-1.4\n" + b"1 0 obj\n<< /Type /Page /Parent 5 0 R >>\nendobj\n" * 4
    assert count(no_root) == 4
    broken = _packed(5).replace(b"\nstream\n", b"\nstream\nxx")
    assert [count(x) for x in (None, b"", b"no report", b"%PDF-1.4\n", broken)] == [None] * 5
    assert count(b"%PDF-1.4\n" + b"1 0 obj " * 100_000) is None


def test_catalog_takes_its_pages_from_the_files(spark, tmp_path):
    folder = tmp_path / "Penn State"
    folder.mkdir()
    (folder / "Penn State - Iowa 1-0.pdf").write_bytes(_plain(26))
    (folder / "Ohio - Penn State 0-0.pdf").write_bytes(_packed(24))
    (folder / "Penn State - Bad.pdf").write_bytes(b"junk")
    pages = read_page_counts(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.page_count) for r in pages.collect()) == [("Ohio - Penn State 0-0.pdf", 24), ("Penn State - Bad.pdf", None), ("Penn State - Iowa 1-0.pdf", 26)]
    plan = crop_plan(report_catalog(with_page_counts(list_reports(spark, str(tmp_path)), pages), "Penn State"))
    got = {(r.file[:4], r.crop_no): r.page for r in plan.collect()}
    assert got["Penn", 1] is not None and got["Ohio", 1] == 11 and {r.page for r in plan.where("file LIKE '%Iowa%' AND crop_no = 1").collect()} == {12}
    assert {r.page for r in plan.where("file LIKE '%Bad%' AND crop_no = 1").collect()} == {None}
