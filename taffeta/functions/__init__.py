"""Column -> Column building blocks. Everything here is a built-in Spark expression."""

from taffeta.functions.text import (  # noqa: F401
    JS_WS, PY_WS, char_class, py_split_ws, py_strip, tokens_of,
)
