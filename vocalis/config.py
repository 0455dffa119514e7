"""Configuration: a YAML (or JSON) mapping with attribute access and paths relative to its own folder."""

from __future__ import annotations

import json
import os
import random
from collections.abc import Iterator
from typing import Any

import numpy as np

#: What a configuration may leave out.
DEFAULTS: dict[str, Any] = {
    "seed": 1337,
    "audio": {"sample_rate": 16000, "duration": 4.0, "mono": True, "pre_emphasis": 0.97, "peak_normalize": False, "remove_silence": False, "trim_top_db": 30, "pad_mode": "repeat", "crop_mode": "head", "frame_length_ms": 25.0, "frame_shift_ms": 10.0, "window": "hamming", "n_fft": None, "center": False},
    "manifest": {"format": "csv", "val_fraction": 0.15, "split_seed": 1337, "hash_bytes": 262144},
    "qc": {"max_files": 2000, "sample_seed": 1337, "clipping_threshold": 0.99, "silence_top_db": 30},
    "synthetic": {"n_speakers": 8, "n_utts_per_speaker": 15, "duration": 2.0, "duration_jitter": 0.5, "sample_rate": 16000, "spoof_fraction": 0.5, "attacks": ["A01", "A02"], "lowpass_hz": 7000},
}


class Node:
    """A mapping read by attribute or item; mappings inside it, also in lists, are nodes."""

    def __init__(self, values: dict[str, Any]):
        if not isinstance(values, dict):
            raise TypeError(f"a mapping is needed, not {type(values).__name__}")
        object.__setattr__(self, "_values", {k: _node(v) for k, v in values.items()})

    def __getattr__(self, name: str) -> Any:
        try:
            return object.__getattribute__(self, "_values")[name]
        except KeyError:
            raise AttributeError(f"no key {name!r} among {sorted(self._values)}") from None

    def __setattr__(self, name: str, value: Any) -> None:
        self._values[name] = _node(value)

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __contains__(self, name: object) -> bool:
        return name in self._values

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({sorted(self._values)})"

    def get(self, name: str, default: Any = None) -> Any:
        return self._values.get(name, default)

    def to_dict(self) -> dict[str, Any]:
        return {k: _plain(v) for k, v in self._values.items()}


def _node(value: Any) -> Any:
    return Node(value) if isinstance(value, dict) else [_node(x) for x in value] if isinstance(value, list) else value


def _plain(value: Any) -> Any:
    return value.to_dict() if isinstance(value, Node) else [_plain(x) for x in value] if isinstance(value, list) else value


class Config(Node):
    """A node with the folder that relative entries of `paths` start from."""

    def __init__(self, values: dict[str, Any], root: str):
        super().__init__(values)
        object.__setattr__(self, "project_root", root)

    def path(self, key: str, *parts: str) -> str:
        """paths.<key> and parts below it: absolute, or with a scheme, as it is; else below the root."""
        raw = os.path.expanduser(str(getattr(self.paths, key)))
        base = raw if os.path.isabs(raw) or "://" in raw else os.path.join(self.project_root, raw)
        return os.path.join(base, *parts)

    def ensure_dir(self, key: str, *parts: str) -> str:
        """path(), made if it is a missing local folder."""
        target = self.path(key, *parts)
        if "://" not in target:
            os.makedirs(target, exist_ok=True)
        return target


def _over(base: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
    return base | {k: _over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def load_config(path: str) -> Config:
    """The file's mapping over DEFAULTS; its folder is the root."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such configuration: {path}")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} needs PyYAML; a .json configuration does not") from e
        values = yaml.safe_load(text)
    if not isinstance(values, dict):
        raise ValueError(f"{path} holds no mapping")
    return Config(_over(DEFAULTS, values), os.path.dirname(os.path.abspath(path)))


def set_seed(seed: int) -> None:
    """Seeds the driver's global generators; no operator draws from them, each takes its seed as an argument."""
    os.environ["PYTHONHASHSEED"] = str(seed)
    random.seed(seed)
    np.random.seed(seed)


def new_rng(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)


def frame_params(config: Config) -> tuple[int, int, int]:
    """Samples of a frame and of a step, and FFT points: n_fft, or the next power of two."""
    a = config.audio
    frame, step = (int(round(a.sample_rate * ms / 1000)) for ms in (a.frame_length_ms, a.frame_shift_ms))
    return frame, step, int(a.n_fft) if a.n_fft else 1 << max(0, frame - 1).bit_length()
