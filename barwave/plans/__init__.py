"""Named queries by family."""

from importlib import import_module

FAMILIES = ("sources", "prices", "windows", "zigzags", "candles", "outcomes", "movements", "harmonics", "gartleys", "waves", "readings", "texts", "streams", "setups", "triangles", "frames")


def load() -> None:
    for family in FAMILIES:
        import_module(f"barwave.plans.{family}")
