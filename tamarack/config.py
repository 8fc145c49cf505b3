"""Settings: constants of the index, overrides from the environment, JSON documents."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

#: Extensions that are indexed, by area.
INDEXED = frozenset(
    f".{x}"
    for x in """
    adoc csv md rst txt
    bash bat cmd fish ksh ps1 psm1 sh zsh
    c cc cpp cxx h hh hpp ino mk
    config cs cshtml csproj csx fs fsi fsproj fsx resx sln vb vbproj xaml
    cql hql psql sql
    css html less scss astro svelte vue
    cfg env ini ipynb json json5 properties toml xml yaml yml
    cjs js jsx mjs ts tsx
    go m mm plist rb rs storyboard swift xib
    gradle groovy gvy java kt kts sc scala
    php phtml tpl twig
    py pyi tf tfvars""".split()
)
#: Extensions that are split along syntax, with their languages.
LANGUAGES = {
    f".{ext}": language
    for language, exts in {"python": "py pyi", "java": "java", "csharp": "cs", "typescript": "ts tsx", "javascript": "js jsx", "go": "go", "rust": "rs", "cpp": "cpp cc cxx hpp", "c": "c h"}.items()
    for ext in exts.split()
}
CODE = frozenset(LANGUAGES) - {".h", ".hpp"} | {".csx"}
EXCLUDED = frozenset([".git", ".gradle", ".idea", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "out", "target", "venv"])


@dataclass(frozen=True)
class Config:
    """All tunables; ``from_env`` reads TAMARACK_<NAME> for each."""

    chunk_size: int = 800
    overlap: int = 200
    max_file_bytes: int = 500_000
    max_chunk_length: int = 8000
    top_k: int = 16
    overfetch: int = 3
    max_chars: int = 4000
    metric: str = "l2sq"
    dimensions: int = 64
    collection: str = "chunks"
    alpha: float = 0.3
    beta: float = 0.6
    max_hops: int = 3
    graph: bool = False
    embed_model: str = "hashing"

    def __post_init__(self):
        check_window(self.chunk_size, self.overlap)
        if self.metric not in ("l2sq", "cosine", "ip"):
            raise ValueError(f"unknown metric {self.metric!r}")

    @classmethod
    def from_env(cls, environment=None) -> Config:
        env, out = os.environ if environment is None else environment, cls()
        for f in fields(cls):
            if (text := env.get(f"TAMARACK_{f.name.upper()}")) is not None:
                kind = type(getattr(out, f.name))
                value = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
                out = replace(out, **{f.name: value})
        return out


def check_window(size: int, overlap: int) -> None:
    """A window must advance."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, not overlap {overlap} and size {size}")


def deep_merge(base: dict, over: dict | None) -> dict:
    """base with over's values; dictionaries on both sides are merged, else over wins."""
    out = dict(base)
    for key, value in (over or {}).items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_json(path: str) -> dict:
    """A JSON object from a file; a missing or broken file counts as empty."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save_json(path: str, value: dict) -> None:
    """Written aside and moved into place."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)
    os.replace(f"{path}.new", path)


def load_prompts(path: str) -> dict[str, str]:
    """The ``summarizer`` and ``chat`` templates of a prompt file; both must be strings."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not all(isinstance(found.get(k), str) for k in ("summarizer", "chat")):
        raise ValueError("a prompt file holds an object with the strings summarizer and chat")
    return {k: found[k] for k in ("summarizer", "chat")}


def save_prompts(path: str, prompts: dict[str, str]) -> None:
    """Write a prompt file that load_prompts reads."""
    if not all(isinstance(prompts.get(k), str) for k in ("summarizer", "chat")):
        raise ValueError("prompts are the strings summarizer and chat")
    save_json(path, {k: prompts[k] for k in ("summarizer", "chat")})
