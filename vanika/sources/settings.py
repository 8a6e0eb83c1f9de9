"""A project's folders and its settings file, on any file system that Spark or Arrow reaches."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs

from vanika.sources.media import _open
from vanika.sources.reports import SETTINGS


@dataclass(frozen=True)
class ProjectPaths:
    """Where a project keeps what: names below root, which may be a URI. The names."""

    root: str

    NAMES = {
        "sources": "sources", "transcripts": "sources/transcripts", "audio_raw": "audio/raw", "audio_resampled": "audio/resampled", "aligned": "aligned",
        "training_set": "training_set", "checkpoints": "checkpoints", "engine": "engine", "logs": "logs",
    }

    def of(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{self.NAMES[name]}"

    @property
    def config(self) -> str:
        return f"{self.root.rstrip('/')}/config.yaml"

    @property
    def urls(self) -> str:
        return f"{self.of('sources')}/urls.txt"

    def ensure(self) -> None:
        """Make all folders that aren't there."""
        for name in self.NAMES:
            system, at = _open(self.of(name))
            system.create_dir(at, recursive=True)


def create(projects: str, name: str) -> ProjectPaths:
    """A new project's folders and settings; settings that are there stay."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError(f"not a project's name: {name!r}")
    paths = ProjectPaths(f"{projects.rstrip('/')}/{name}")
    paths.ensure()
    if not _there(paths.config):
        write(SETTINGS | {"name": name}, paths.config)
    return paths


def _there(path: str) -> bool:
    system, at = _open(path)
    return system.get_file_info(at).type == fs.FileType.File


def read(path: str) -> dict:
    """A project's settings over those of a new one, nested ones too. An error without the file."""
    if not _there(path):
        raise FileNotFoundError(f"no settings at {path}")
    system, at = _open(path)
    with system.open_input_stream(at) as f:
        own = loads(f.read().decode())
    return {k: {**v, **(own.get(k) or {})} if isinstance(v, dict) else own.get(k, v) for k, v in ({k: v for k, v in own.items() if k not in SETTINGS} | SETTINGS).items()}


def write(settings: dict, path: str) -> None:
    """Block YAML; written aside and renamed."""
    system, at = _open(path)
    with system.open_output_stream(f"{at}.new") as f:
        f.write(dumps(settings).encode())
    system.move(f"{at}.new", at)


def dumps(settings: dict, depth: int = 0) -> str:
    """Nested mappings of plain values as block YAML: a key a line, texts in JSON's quotes."""
    out = ""
    for key, value in settings.items():
        out += "  " * depth + str(key) + ":"
        out += "\n" + dumps(value, depth + 1) if isinstance(value, dict) and value else f" {json.dumps(value, ensure_ascii=False)}\n"
    return out


def _value(text: str) -> object:
    """One YAML value: JSON's, or null, booleans and numbers as YAML has them, or else a text."""
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[-+]?[0-9][0-9_]*", text):
        return int(text.replace("_", ""))
    if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?", text):
        return float(text)
    return json.loads(text) if text[0] in '"[{' else text


def loads(text: str) -> dict:
    """JSON, or YAML of nested mappings with plain values and lists of them, which is what settings are. Other YAML is an error."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    open_: list[tuple[int, dict, str | None]] = [(-1, {"": out}, "")]  # indentation, mapping, the key whose value may follow
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#[^\"']*$", "", raw).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        depth = len(line) - len(line.lstrip())
        while len(open_) > 1 and depth < open_[-1][0]:
            open_.pop()
        level, mapping, last = open_[-1]
        if item := re.match(r"\s*-\s+(.*)", line):
            held = mapping.get(last) or []
            mapping[last] = [*held, _value(item[1])]
            continue
        pair = re.match(r"\s*([\w.-]+|\"[^\"]*\")\s*:(?:\s+(.*))?$", line)
        if not pair:
            raise ValueError(f"line {number} is no setting: {raw!r}")
        key = pair[1].strip('"')
        if depth > level:  # the value of the key before
            inner = out if level < 0 else {}
            mapping[last] = inner
            mapping, level = inner, depth
            open_.append((depth, mapping, key))
        mapping[key] = _value((pair[2] or "").strip())
        open_[-1] = (level, mapping, key)
    return out
