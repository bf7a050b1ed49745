from . import bind, io  # noqa: F401
