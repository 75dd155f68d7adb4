"""Document functions that columns cannot express: Arrow-batched helpers over markdown, HTML and JSON texts."""

from __future__ import annotations

import difflib
import fnmatch
import hashlib
import html
import ipaddress
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
_BLOCK_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "title"}


def markdown_links(text: str) -> list[dict]:
    """Links outside code and images, with their line from 1."""
    clean = _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    return [{"text": m[2], "target": m[3], "line": clean.count("\n", 0, m.start()) + 1} for m in _LINK.finditer(clean) if not m[1]]


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: list[str] = []
        self.text = ""

    def _close(self) -> None:
        text = " ".join(self.text.split())
        if text:
            kind = next((t for t in reversed(self.open) if t in _BLOCK_TAGS), "text")
            self.blocks.append({"path": len(self.blocks), "type": kind, "text": text})
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK_TAGS:
            self._close()
            self.open.append(tag)
        elif tag in ("script", "style"):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            if tag in _BLOCK_TAGS:
                self._close()
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not {"script", "style"} & set(self.open):
            self.text += data


def html_blocks(text: str) -> list[dict]:
    """Blocks of an HTML page in order: place, tag and collapsed text."""
    p = _Blocks()
    p.feed(text)
    p._close()
    return p.blocks


def adf_blocks(text: str, most: int = 10_000) -> list[dict]:
    """Blocks of a JSON document tree: place, type and the text below; deeper blocks follow their parents."""
    out: list[dict] = []
    inner = {"text", "mention", "emoji", "hardBreak", "inlineCard", "date", "status"}

    def said(node: dict) -> str:
        if node.get("type") == "text":
            return node.get("text", "")
        if node.get("type") == "hardBreak":
            return "\n"
        return (node.get("attrs") or {}).get("text", "") + "".join(said(c) for c in node.get("content") or [])

    stack = [json.loads(text)] if text else []
    while stack and len(out) < most:
        node = stack.pop()
        children = node.get("content") or []
        if node.get("type") not in inner and node.get("type") != "doc":
            out.append({"path": len(out), "type": node.get("type", ""), "text": "".join(said(c) for c in children if c.get("type") in inner)})
        stack.extend(c for c in reversed(children) if c.get("type") not in inner)
    return out


def headings_toc(text: str) -> list[dict]:
    """Headings of a markdown text with depth below the shallowest one and a unique anchor."""
    found = [(len(m[1]), m[2].strip()) for m in re.finditer(r"(?m)^(#{1,6})\s+(.+?)\s*#*$", _CODE.sub("", text))]
    least, seen, out = min((n for n, _ in found), default=1), {}, []
    for level, title in found:
        anchor = heading_slug(title)
        n = seen[anchor] = seen.get(anchor, 0) + 1
        out.append({"depth": level - least, "title": title, "anchor": anchor if n == 1 else f"{anchor}-{n}"})
    return out


def heading_slug(text: str) -> str:
    x = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    x = "".join(c for c in x if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", "-", x).strip("-") or "anchor"


def path_slug(text: str, reserved: frozenset[str] = frozenset({"index", "assets", "api"})) -> str:
    """Letters and digits of any script; a reserved name gets a suffix."""
    x = re.sub(r"[^\w]+|_", "-", unicodedata.normalize("NFKC", text).lower()).strip("-") or "page"
    return f"{x}-page" if x in reserved else x


def canonical_json(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a(text: str) -> str:
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def _base36(n: int) -> str:
    out = ""
    while n:
        n, digit = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return out or "0"


def _hash_of_units(text: str) -> str:
    """FNV-1a over UTF-16 units, in base 36."""
    data, h = text.encode("utf-16-le", "surrogatepass"), 0x811C9DC5
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return _base36(h)


def _hashed_anchor(base: str, source: str, most: int) -> str:
    mark = _hash_of_units(source)
    head = base[: max(0, most - len(mark) - 1)].rstrip("-")
    return f"{head}-{mark}" if head else mark


def anchor_id(name: str, most: int = 40) -> str:
    """An id of a-z, 0-9 and ``-`` for an anchor's name; longer ones end in a hash of the name."""
    folded = unicodedata.normalize("NFKD", re.sub(r"[\x00-\x1f\x7f]", "", name))
    base = re.sub("[^a-z0-9]+", "-", re.sub("[\u0300-\u036f]", "", folded).lower()).strip("-") or "anchor"
    return base if len(base) <= most else _hashed_anchor(base, name, most)


def unique_anchors(names: list[str], most: int = 40) -> list[str]:
    """The anchor ids of a page's names in order: an id that is taken gets a hash of its name, then of its name and a number."""
    taken: set[str] = set()
    out = []
    for name in names:
        name = name or ""
        found = base = anchor_id(name, most)
        salt = 0
        while found in taken:
            found = _hashed_anchor(base, f"{name}#{salt}" if salt else name, most)
            salt += 1
        taken.add(found)
        out.append(found)
    return out


def unified_diff(old: str, new: str) -> dict:
    lines = list(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="", n=3))
    hunks = sum(x.startswith("@@") for x in lines)
    return {"hunks": hunks, "additions": sum(x.startswith("+") and not x.startswith("+++") for x in lines), "deletions": sum(x.startswith("-") and not x.startswith("---") for x in lines), "text": "\n".join(lines)}


def _changes(base: list[str], side: list[str]) -> list[tuple[int, int, list[str]]]:
    return [(i, j, side[k:m]) for tag, i, j, k, m in difflib.SequenceMatcher(None, base, side, autojunk=False).get_opcodes() if tag != "equal"]


def merge_three(base: str, local: str, remote: str) -> dict:
    """Three-way merge by lines: separate changes are both taken, equal ones once, others stand between markers."""
    if local == remote or remote == base:
        return {"text": local, "conflicts": 0}
    if local == base:
        return {"text": remote, "conflicts": 0}
    b, sides = base.split("\n"), (local.split("\n"), remote.split("\n"))
    mine, theirs = (_changes(b, s) for s in sides)
    out, at, conflicts = [], 0, 0
    while mine or theirs:
        start = min(x[0][0] for x in (mine, theirs) if x)
        out += b[at:start]
        end, took = start, ([], [])
        grew = True
        while grew:  # changes that touch one another belong to one region
            grew = False
            for own, queue in zip(took, (mine, theirs)):
                while queue and (queue[0][0] < end or queue[0][0] == start and not own):
                    own.append(queue.pop(0))
                    end, grew = max(end, own[-1][1]), True

        def built(own: list) -> list[str]:
            text, p = [], start
            for i, j, put in own:
                text += b[p:i] + put
                p = j
            return text + b[p:end]

        a, c = built(took[0]), built(took[1])
        if not took[1] or a == c:
            out += a
        elif not took[0]:
            out += c
        else:
            conflicts += 1
            out += ["<<<<<<< LOCAL", *a, "=======", *c, ">>>>>>> REMOTE"]
        at = end
    return {"text": "\n".join(out + b[at:]), "conflicts": conflicts}


def resolve_conflicts(text: str, side: str) -> str:
    """One side of each marked conflict: ``local`` or ``remote``."""
    return re.sub(r"<<<<<<< LOCAL\n(.*?\n)?=======\n(.*?\n)?>>>>>>> REMOTE\n?", lambda m: (m[1] if side == "local" else m[2]) or "", text, flags=re.S)


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether the last pattern that matches ignores a path; ``!`` takes a path back, ``/`` anchors, a trailing ``/`` means folders."""
    hit = False
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.lstrip("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        parts = path.split("/")
        heads = ["/".join(parts[: i + 1]) for i in range(len(parts) - folder)]
        anchored = "/" in p
        names = heads if anchored else parts[: len(heads)]
        if any(fnmatch.fnmatchcase(n, p.lstrip("/")) for n in names):
            hit = not keep
    return hit


def private_host(host: str) -> bool:
    """Loopback, private, link-local, reserved and unspecified addresses, and names that only exist locally."""
    h = host.strip("[]").lower().rstrip(".")
    try:
        ip = ipaddress.ip_address(h)
    except ValueError:
        return h == "localhost" or h.endswith((".localhost", ".local", ".internal")) or "." not in h
    mapped = getattr(ip, "ipv4_mapped", None)
    return (mapped or ip).is_private or (mapped or ip).is_reserved or (mapped or ip).is_link_local or (mapped or ip).is_multicast


def redacted(value, key: str = ""):
    """A JSON value without secrets: values of sensitive keys are hidden, an authorisation keeps its scheme."""
    from tessera.functions.texts import SENSITIVE

    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, key) for v in value]
    if isinstance(value, str) and any(s in key.lower() for s in SENSITIVE):
        scheme = re.match(r"(Basic|Bearer)\s", value, re.I)
        return f"{scheme[1]} [REDACTED]" if scheme else "[REDACTED]"
    return value


def redacted_json(text: str) -> str:
    return json.dumps(redacted(json.loads(text)), sort_keys=True)


def unescaped(text: str) -> str:
    """Search excerpts without highlight marks and with their entities resolved."""
    return html.unescape(re.sub(r"@@@(?:end)?hl@@@", "", text))


def rendered(template: str, values: dict) -> str:
    """``{{name}}`` and ``{{upper name}}``, ``{{lower name}}``; unknown names become nothing."""
    def put(m: re.Match) -> str:
        *fn, name = m[1].split()
        x = str(values.get(name, ""))
        return {"upper": x.upper(), "lower": x.lower(), "uppercase": x.upper(), "lowercase": x.lower()}.get(fn[0], x) if fn else x

    return re.sub(r"\{\{\s*([^{}]+?)\s*\}\}", put, template)


def markdown_issues(text: str, most: int = 500_000) -> list[dict]:
    """What is wrong with a page: unclosed code, empty or unsafe links, links without text, excess size."""
    out = []
    if text.count("```") % 2:
        out.append({"code": "unclosed-code", "severity": "error"})
    for link in markdown_links(text):
        if link["target"].lower().startswith(("javascript:", "data:")):
            out.append({"code": "unsafe-link", "severity": "error"})
        if not link["text"].strip():
            out.append({"code": "link-without-text", "severity": "warning"})
    out += [{"code": "empty-link", "severity": "warning"} for _ in re.finditer(r"\[[^\]]*\]\(\s*\)", text)]
    if len(text) > most:
        out.append({"code": "too-large", "severity": "error"})
    return out


_LINKS = "array<struct<text:string,target:string,line:int>>"
_BLOCKS = "array<struct<path:int,type:string,text:string>>"


def column(function, returns: str):
    """A function of texts as an Arrow-batched column function; null gives null."""

    if returns.startswith("struct<"):
        names = [f.split(":")[0] for f in returns[len("struct<") : -1].split(",")]

        @F.pandas_udf(returns)
        def run(*series: pd.Series) -> pd.DataFrame:
            rows = [dict.fromkeys(names) if any(v is None for v in row) else function(*row) for row in zip(*series)]
            return pd.DataFrame(rows, columns=names)
    else:

        @F.pandas_udf(returns)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*series)], dtype=object)

    return run


COLUMNS = {
    "markdown_links": (markdown_links, _LINKS), "html_blocks": (html_blocks, _BLOCKS), "adf_blocks": (adf_blocks, _BLOCKS),
    "headings_toc": (headings_toc, "array<struct<depth:int,title:string,anchor:string>>"), "heading_slug": (heading_slug, "string"), "path_slug": (path_slug, "string"),
    "canonical_json": (canonical_json, "string"), "fnv1a": (fnv1a, "string"), "unified_diff": (unified_diff, "struct<hunks:int,additions:int,deletions:int,text:string>"),
    "merge_three": (merge_three, "struct<text:string,conflicts:int>"), "private_host": (private_host, "boolean"), "redacted_json": (redacted_json, "string"),
    "unescaped": (unescaped, "string"), "markdown_issues": (markdown_issues, "array<struct<code:string,severity:string>>"),
}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
