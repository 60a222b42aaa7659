import asyncio
import json

import pytest

from pagemill.local import aclean, clean, main

HTML = "<title>T</title><article><p>" + "Words and words. " * 30 + '<a href="/x">l</a></p></article>'


def test_clean():
    r = clean(HTML, url="https://x.org/a")
    assert r["pageType"] == "article" and r["metadata"]["title"] == "T" and "confidence" not in r and r["html"].startswith("<p>Words")
    assert "<a" not in clean(HTML, include_links=False)["html"]
    assert asyncio.run(aclean(HTML, url="https://x.org/a")) == r
    with pytest.raises(ValueError):
        clean(HTML, max_input_bytes=10)
    with pytest.raises(TypeError):
        clean(None)


def test_command_line(tmp_path, capsys):
    f, out = tmp_path / "a.html", tmp_path / "o.json"
    f.write_text(HTML)
    assert main([str(f), "--json", "-o", str(out), "--url", "https://x.org"]) == 0
    assert json.loads(out.read_text())["metadata"]["hostname"] == "x.org"
    assert main([str(f), "--no-links"]) == 0
    said = capsys.readouterr()
    assert "<a" not in said.out and "[article]" in said.err
    assert main([str(tmp_path / "none")]) == 1 and main([str(f), "--config", str(f)]) == 1
