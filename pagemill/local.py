"""One page at a time, without a session: ``clean(html)`` and the command line.

    python -m pagemill [FILE] [-o OUT] [--json] [--boilerplate MODE] ...
"""

from __future__ import annotations

import argparse
import asyncio
import json
import sys

from .html import sanitize as S
from .operators.pages import MAX_INPUT, MODES, check_options, clean_one, load_config


def clean(
    html: str,
    *,
    boilerplate: str = "balanced",
    include_images: bool | None = None,
    include_tables: bool | None = None,
    include_links: bool | None = None,
    include_comments: bool | None = None,
    minify: bool = False,
    url: str | None = None,
    config: dict | None = None,
    page_type: str | None = None,
    max_input_bytes: int = MAX_INPUT,
    hardened: bool = False,
) -> dict:
    """The result of one page; fields without a value are left out."""
    if not isinstance(html, str):
        raise TypeError("html must be a string")
    check_options(boilerplate, page_type, include_images=include_images, include_tables=include_tables, include_links=include_links, include_comments=include_comments)
    if len(html.encode("utf-8", "surrogatepass")) > max_input_bytes:
        raise ValueError(f"input exceeds {max_input_bytes} bytes")
    rules = S.derive(S.Config.of(config) if config is not None else S.DEFAULT, include_images, include_tables, include_links)
    out, messages, meta, kind, confidence = clean_one(html, url, boilerplate, rules, minify, page_type, hardened=hardened)
    result = {"html": out, "metadata": meta, "pageType": kind, "confidence": confidence, "messages": messages}
    return {k: v for k, v in result.items() if v is not None}


async def aclean(html: str, **options) -> dict:
    return await asyncio.to_thread(clean, html, **options)


def main(argv: list[str] | None = None) -> int:
    """0 where the page was cleaned, 1 where it could not be read or written."""
    p = argparse.ArgumentParser(prog="pagemill", description="Clean a web page.")
    p.add_argument("input", nargs="?", help="an HTML file; standard input if left out")
    p.add_argument("-o", "--output")
    p.add_argument("--boilerplate", default="balanced", choices=MODES)
    for name in ("images", "tables", "links", "comments"):
        p.add_argument(f"--no-{name}", dest=name, action="store_const", const=False)
    p.add_argument("--minify", action="store_true")
    p.add_argument("--url")
    p.add_argument("--config", help="a JSON file with a cleaning configuration")
    p.add_argument("--json", action="store_true", help="the whole result as JSON")
    p.add_argument("-q", "--quiet", action="store_true", help="no diagnostics")
    o = p.parse_args(argv)
    try:
        if o.input:
            with open(o.input, encoding="utf-8", errors="replace") as f:
                html = f.read()
        else:
            html = sys.stdin.buffer.read().decode("utf-8", "replace")
        config = load_config(o.config) if o.config else None
        r = clean(html, boilerplate=o.boilerplate, include_images=o.images, include_tables=o.tables, include_links=o.links, include_comments=o.comments, minify=o.minify, url=o.url, config=config)
        out = json.dumps(r, indent=2, ensure_ascii=False) if o.json else r["html"]
        if o.output:
            with open(o.output, "w", encoding="utf-8") as f:
                f.write(out)
        else:
            try:
                sys.stdout.write(out + "\n")
                sys.stdout.flush()
            except BrokenPipeError:
                return 0
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not (o.quiet or o.json):
        for m in r["messages"]:
            print(f"[{m['type']}] {m['text']}", file=sys.stderr)
        if "pageType" in r:
            print(f"[{r['pageType']}" + (f" {r['confidence']:.3f}]" if "confidence" in r else "]"), file=sys.stderr)
    return 0
