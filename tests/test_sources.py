"""Files of each format, good and broken, below one folder."""

from __future__ import annotations

import hashlib
import zipfile

from lectern.sources import files


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as out:
        for name, text in parts.items():
            out.writestr(name, text)


def test_scan_of_all_formats(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("# Head\n==> picture <==\ntext é", encoding="utf-8")
    (tmp_path / "deep/b.TXT").write_bytes(b"ok \xff bytes")
    (tmp_path / "c.html").write_text("<html><head><title>T</title><style>x</style></head><nav>no</nav><h2>Two</h2><p>body &amp; more</p><script>1</script></html>")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    archive(tmp_path / "d.docx", {"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p></w:body></w:document>'})
    archive(tmp_path / "e.odt", {"content.xml": '<d xmlns:t="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:p>first</t:p><t:p/><t:p>second</t:p></d>'})
    archive(tmp_path / "f.epub", {"x.opf": '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title></p>', "1.xhtml": "<h1>Ch</h1><p>words</p>"})
    (tmp_path / "g.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Bold\b0  caf\'e9\par next \{x\}}")
    (tmp_path / "h.docx").write_bytes(b"not a zip")
    (tmp_path / "i.pdf").write_bytes(b"%PDF")
    (tmp_path / "j.txt").write_text("   ")
    (tmp_path / "k.bin").write_text("never read")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert {k: v.text for k, v in got.items() if v.text is not None} == {
        "a.md": "# Head\ntext é",
        "b.TXT": "ok  bytes",
        "c.html": "## Two\nbody & more",
        "d.docx": "# Top\n\none two",
        "e.odt": "first\n\nsecond",
        "f.epub": "# Book\n\n# Ch\nwords",
        "g.rtf": "Bold café\nnext {x}",
        "j.txt": "   ",
    }
    assert got["h.docx"].error.startswith("BadZipFile") and got["i.pdf"].error == "no reader for this format" and "k.bin" not in got
    loaded = {r.path.rsplit("/", 1)[1]: r.doc_hash for r in files.load(spark, str(tmp_path)).collect()}
    assert len(loaded) == 7 and loaded["e.odt"] == hashlib.sha256(b"first\n\nsecond").hexdigest()[:16]
