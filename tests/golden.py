"""A small call graph: main -> init_system -> setup_network -> connect_socket, a macro and a type."""

SYMBOLS = [
    (1, "main", "main", "function", None, "src/main.cpp", 1, 1, 50, True, "int", None, None, None, "p"),
    (2, "init_system", "core::init_system", "function", None, "src/core.cpp", 10, 1, 30, True, "void", None, "public", None, "p"),
    (3, "setup_network", "net::setup_network", "function", None, "src/network.cpp", 5, 1, 25, True, "void", None, "public", None, "p"),
    (4, "connect_socket", "net::connect_socket", "function", None, "src/network.cpp", 30, 1, 60, True, "int", None, "private", None, "p"),
    (5, "MAX_CONNECTIONS", "MAX_CONNECTIONS", "macro", None, "src/config.h", 1, 1, None, True, None, None, None, None, "p"),
    (6, "Connection", "net::Connection", "type", "class", "src/network.h", 10, 1, 50, True, None, None, "public", None, "p"),
]
CALLS = [
    (10, 1, 2, "src/main.cpp", 12, 3, False, False),
    (11, 2, 3, "src/core.cpp", 15, 3, False, False),
    (12, 3, 4, "src/network.cpp", 20, 3, True, False),
]


def frames(spark, symbols=SYMBOLS, calls=CALLS):
    from lattica.schema import struct_of

    return spark.createDataFrame(symbols, struct_of("symbols")), spark.createDataFrame(calls, struct_of("call_relations"))


def plain(id_, name, qualified=None, kind="function", file="a.cpp", line=1, definition=True, end=None, attributes=None):
    return (id_, name, qualified or name, kind, None, file, line, 1, end, definition, None, None, None, attributes, "p")


def call(id_, a, b):
    return (id_, a, b, "a.cpp", id_, 1, False, False)
