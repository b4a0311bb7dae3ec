"""Relative URL resolution as browsers do it, for Python workers."""

from __future__ import annotations

import re

_ABS = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(.*)$", re.S)
_OWN = {"http": "80", "https": "443", "ftp": "21"}
_SAFE_PATH = frozenset("!$%&'()*+,-./:;=@[\\]^_|~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SAFE_QUERY = frozenset(_SAFE_PATH | set("?`{}")) - {"'"}


def _encode(text: str, safe: frozenset) -> str:
    return "".join(c if c in safe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def split(url: str) -> tuple[str, str, str, str, str] | None:
    """(scheme, authority, path, query, fragment) of an absolute http(s) URL, normalised, or None."""
    m = _ABS.match(re.sub("[\t\r\n]", "", url.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f ")))
    if not m or m[1].lower() not in ("http", "https"):
        return None
    scheme, rest = m[1].lower(), m[2]
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    user, at, hostport = authority.rpartition("@")
    host, colon, port = hostport.rpartition(":") if re.search(r":[0-9]*$", hostport) else (hostport, "", "")
    host = host.lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if not host or re.search(r"[\s<>^|%#/?@\\]", host):
        return None
    if port == _OWN[scheme]:
        port = ""
    return scheme, user + at + host + (":" + port if port else ""), _encode(_dots("/" + path), _SAFE_PATH), mark + _encode(query, _SAFE_QUERY), hash_ + fragment


def resolve(href: str, base: str, fragment: bool = False) -> str | None:
    """Absolute form of a link without its fragment; None for other schemes and broken links."""
    href = re.sub("[\t\r\n]", "", href.strip())
    if _ABS.match(href) and not re.match(r"^https?:(?!//)", href, re.I):
        got = split(href)
    else:
        b = split(base)
        if b is None:
            return None
        href = re.sub(r"^https?:(?!//)", "", href, flags=re.I)
        scheme, auth, path, query, _ = b
        rel, hash_, frag = href.partition("#")
        p, mark, q = rel.partition("?")
        p = p.replace("\\", "/")
        if p.startswith("//"):
            got = split(f"{scheme}:{p}{mark}{q}{hash_}{frag}")
        else:
            if not p:
                target, query = path, (mark + _encode(q, _SAFE_QUERY)) if mark else query
            else:
                target = p if p.startswith("/") else path.rsplit("/", 1)[0] + "/" + p
                query = mark + _encode(q, _SAFE_QUERY)
            got = (scheme, auth, _encode(_dots(target), _SAFE_PATH), query, hash_ + frag)
    if got is None:
        return None
    scheme, auth, path, query, frag = got
    return f"{scheme}://{auth}{path}{query}{frag if fragment else ''}"
