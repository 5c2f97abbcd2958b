"""python -m panewright.lint BUNDLE.yaml...: checks bundles and prints the lanes they need. Exit 1 if one is refused."""

from __future__ import annotations

import sys
from pathlib import Path

from .model import ConfigError
from .operators import lanes
from .plans import bundle


def lint(path: str) -> int:
    try:
        found = bundle.load(Path(path))
        admission = bundle.validate(found, strict=False)
        print(f"# {found.name}\n\n{admission.lanes.markdown()}\n")
        for w in admission.warnings:
            print(f"warning: {w}")
        if admission.lanes.has_overflow:
            print(f"error: more than {lanes.CAP} lanes")
            return 1
    except (ConfigError, OSError) as e:
        print(f"error: {path}: {e}")
        return 1
    return 0


def main() -> None:
    if not sys.argv[1:]:
        sys.exit(__doc__)
    sys.exit(max(map(lint, sys.argv[1:])))


if __name__ == "__main__":
    main()
