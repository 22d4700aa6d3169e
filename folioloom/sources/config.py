"""Settings: defaults, then a JSON file, then what was given explicitly."""

from __future__ import annotations

import json
from dataclasses import fields, replace
from typing import Any

from ..profile import DEFAULT, Profile


def load(text: str | None = None, given: dict[str, Any] | None = None, base: Profile = DEFAULT) -> Profile:
    """A profile; unknown names in the JSON are ignored, values that are None don't count as given."""
    known = {f.name for f in fields(Profile)}
    said = json.loads(text) if text else {}
    out = replace(base, **{k: v for k, v in said.items() if k in known})
    return replace(out, **{k: v for k, v in (given or {}).items() if v is not None and k in known})
