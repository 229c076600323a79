"""Settings from a YAML text and from requests, checked before a plan is made."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from ..functions import constants as K


def read_config(text: str | None) -> dict[str, Any]:
    """The mapping of a YAML text; empty for no text or an empty one. Another root is a TypeError, bad YAML is YAML's own error."""
    import yaml

    data = yaml.safe_load(text) if text else None
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise TypeError(f"a mapping is expected at the root, not {type(data).__name__}")
    return data


def client_override(config, changes: dict[str, Any] | None):
    """``config`` (a dataclass) with the changes of a request. Settings that only an organisation may change are refused, as are unknown ones."""
    if not changes:
        return config
    refused = sorted(K.CLIENT_FORBIDDEN & changes.keys())
    if refused:
        raise PermissionError(f"a request can't change {refused}")
    unknown = sorted(changes.keys() - asdict(config).keys())
    if unknown:
        raise ValueError(f"unknown settings {unknown}")
    return type(config)(**(asdict(config) | changes))
