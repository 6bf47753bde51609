"""Order-free comparison of two Arrow tables."""

import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def family(t):
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "str"
    return str(t)


def rows_of(tab):
    cols = sorted(tab.column_names)
    data = [tab.column(c).to_pylist() for c in cols]

    def norm(v):
        if isinstance(v, float):
            if v != v:
                return "NaN"
            return f"{v + 0.0:.6f}" if v else "0.000000"
        return repr(v)
    return sorted(tuple(norm(v) for v in r) for r in zip(*data)) if data else []


def compare(got, want):
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}", ""
    notes = []
    for c in got.column_names:
        a, b = got.schema.field(c).type, want.schema.field(c).type
        if family(a) != family(b):
            return f"type of {c}: {a} != {b}", ""
        if a != b and not (family(a) == "str"):
            notes.append(f"{c}:{a}/{b}")
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}", ""
    a, b = rows_of(got), rows_of(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}", ""
    return None, " ".join(notes)
