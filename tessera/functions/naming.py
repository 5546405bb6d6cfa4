"""Names of stored artefacts."""

from __future__ import annotations


def model_key(model: str) -> str:
    """A model's name as a file name: what follows the last slash, dashes as underscores."""
    return model.rstrip("/").rpartition("/")[2].replace("-", "_").lower()


def union_name(model: str, k: int) -> str:
    return f"union_{model_key(model)}_k{k}"


def suffix(tags: list[str]) -> str:
    """The suffix of artefacts made with these tags: empty without tags."""
    return "".join(f"_{t}" for t in tags if t)


def tags(text: str) -> list[str]:
    """A comma list of tags; an empty one is the untagged artefact."""
    return [t.strip() for t in text.split(",")]
