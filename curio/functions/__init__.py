from . import text, hashing  # noqa: F401
