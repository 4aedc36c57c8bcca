"""Build configurations: a lean line format and a block format, read on the driver (they are small)."""

from __future__ import annotations

import json
import re
import tomllib

_BLOCK = re.compile(r"(\w+)\s+\"?([\w.\-]+)\"?\s*\{([^{}]*)\}", re.S)
TRUE, FALSE = {"true", "yes", "on"}, {"false", "no", "off"}


def literal(text: str):
    """A word as truth value, number, list or text."""
    t = text.strip().rstrip(",")
    low = t.lower()
    if low in TRUE or low in FALSE:
        return low in TRUE
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    if t.startswith("[") and t.endswith("]"):
        return [literal(x) for x in t[1:-1].split(",") if x.strip()]
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'" else t


def read_blocks(text: str) -> list[dict]:
    """``kind name { key = value ... }`` blocks; comments start with # or //."""
    bare = re.sub(r"(?m)(#|//).*$", "", text)
    out = []
    for kind, name, body in _BLOCK.findall(bare):
        values = {k: literal(v) for k, v in re.findall(r"(?m)^\s*(\w+)\s*[=:]\s*(\[[^\]]*\]|[^\n]+)", body)}
        out.append({"kind": kind, "name": name} | values)
    return out


def read_lean(text: str) -> dict:
    """``key: value`` lines; indented dashes add to the key above."""
    out: dict = {}
    last = None
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        if bare.lstrip().startswith("-") and last:
            if not isinstance(out[last], list):
                out[last] = []
            out[last].append(literal(bare.lstrip()[1:]))
        elif ":" in bare or "=" in bare:
            last, _, value = re.split(r"([:=])", bare.strip(), maxsplit=1)
            last = last.strip()
            out[last] = literal(value) if value.strip() else []
    return out


def read_ini(text: str) -> dict:
    """Sections of ``key = value`` lines, with literals; keys before any section are under ''."""
    out: dict = {}
    section = ""
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if bare.startswith("[") and bare.endswith("]"):
            section = bare[1:-1].strip()
            out.setdefault(section, {})
        elif "=" in bare or ":" in bare:
            key, _, value = re.split(r"([=:])", bare, maxsplit=1)
            out.setdefault(section, {})[key.strip()] = literal(value)
    return out


def sniff(text: str) -> str:
    """json, toml, blocks or lean: the first that the text looks like; sections that are no TOML are ini."""
    t = text.lstrip()
    if t.startswith("{"):
        return "json"
    if _BLOCK.search(text):
        return "blocks"
    if re.search(r"(?m)^\s*\[[^\]]+\]\s*$", text):
        try:
            tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return "ini"
        return "toml"
    return "lean"


def read(text: str):
    kind = sniff(text)
    if kind == "json":
        return json.loads(text)
    if kind == "toml":
        return tomllib.loads(text)
    return read_blocks(text) if kind == "blocks" else read_ini(text) if kind == "ini" else read_lean(text)


def validated(targets: list[dict]) -> list[str]:
    """Faults of targets (name, requires): unknown requirements first; cycles only when there are none."""
    from ..operators.graph import CycleError, kahn_order

    names = {t["name"] for t in targets}
    unknown = [f"{t['name']} requires unknown {r}" for t in targets for r in t.get("requires", []) if r not in names]
    if unknown:
        return unknown
    try:
        kahn_order([(t["name"], list(t.get("requires", []))) for t in targets])
    except CycleError as e:
        return [f"cycle among {e}"]
    return []
