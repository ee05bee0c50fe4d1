"""Function library; each module registers its functions when imported."""

from importlib import import_module

MODULES = ("encodings", "hashing", "text", "slicing", "analytics", "checks", "compression", "addressing", "json_formats", "config", "detect",
           "logs", "archives", "database", "network", "bio", "geo", "documents", "pdf", "science", "ml", "image", "gif", "audio", "binary", "columnar", "serialization", "ipld", "erasure", "ciphers")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
