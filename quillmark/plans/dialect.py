"""Rewrites the dialect's own syntax into Spark SQL; Catalyst plans the rest.

A statement is parsed into a tree of tokens.  Queries are taken apart into clauses,
so what the dialect has beyond Spark is rewritten where it stands: DISTINCT ON,
APPLY, window frames by GROUPS and EXCLUDE, chains of set operators read from the
right, null order, LIKE, vector operators, typed casts, parameters by number, and
the functions of search, vectors and sessions.  Functions that need a table, such
as search scores and graph functions in FROM, ask the ``Context`` for it.
"""

from __future__ import annotations

from quillmark.functions.scalar import micros
from quillmark.plans.tree import Group, Node, Token, find, is_op, parse, quote, render, split, sql, string_of, words

_TYPES = {"text": "string", "float": "double", "numeric": "double", "decimal": "double", "integer": "int", "int2": "smallint", "int4": "int", "int8": "bigint", "bool": "boolean", "json": "string", "jsonb": "string", "uuid": "string", "bytea": "binary", "varchar": "string", "timestamp": "timestamp_ntz"}
_CLAUSES = ("select", "from", "where", "group", "having", "order", "limit", "offset")
_SETS = ("union", "intersect", "except")
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"
_L2 = "sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"
_COSINE = f"coalesce(try_divide({_DOT}, {_NORM} * {_NORM.replace('{a}', '{b}')}), 0D)"
_VECTOR = {"<->": _L2, "<#>": f"(-{_DOT})", "<=>": f"(1 - {_COSINE})"}
_VECTOR_CALLS = {"vector_distance": _L2, "vector_score": f"(1 / (1 + {_L2}))", "cosine_distance": f"(1 - {_COSINE})", "dot_product": f"(-{_DOT})"}
#: Words before a parenthesis that are no functions.
_NO_CALLS = frozenset("over in exists and or not when then else on values using any all some as filter within by from where select like between is distinct having limit offset case interval".split())
GRAPH_CALLS = ("graph_neighbors", "graph_expand", "graph_shortest_path")


class DialectError(ValueError):
    pass


class Context:
    """What rewriting needs to know of the session; a plain one knows no tables."""

    def score(self, table: str, field: str, query: str) -> str:
        raise DialectError("search functions need a table")

    def match(self, field: str, query: str) -> str:
        raise DialectError("search functions need a table")

    def snippet(self, field: str, query: str) -> str:
        raise DialectError("search functions need a table")

    def graph(self, name: str, args: list, starts: str | None = None) -> str:
        raise DialectError("graph functions need a graph")

    def recursive(self, name: str, columns: list[str], anchor: str, step: str) -> str:
        raise DialectError("a recursive UNION needs a session")

    def session(self, name: str, args: list[str | None]) -> str | None:
        """The value of a session function, or None where there is no such function."""
        return None


class Rewriter:
    def __init__(self, context: Context | None = None, args: list | None = None) -> None:
        self.context, self.args, self.numbers = context or Context(), args, 0
        self.used: set[int] = set()

    # --- queries

    def query(self, items: list[Node]) -> list[Node]:
        if items and items[0].word() == "with":
            return self.with_(items)
        parts, kinds = [[]], []
        i = 0
        while i < len(items):
            if items[i].word() in _SETS:
                kind = items[i].word()
                if i + 1 < len(items) and items[i + 1].word() in ("all", "distinct"):
                    kind += " all" if items[i + 1].word() == "all" else ""
                    i += 1
                kinds.append(kind)
                parts.append([])
            else:
                parts[-1].append(items[i])
            i += 1
        if not kinds:
            return self.select(items)
        tail: list[Node] = []
        at = min((k for k in (find(parts[-1], "order", "by"), find(parts[-1], "limit"), find(parts[-1], "offset")) if k >= 0), default=-1)
        if at >= 0:
            parts[-1], tail = parts[-1][:at], parts[-1][at:]
        out = self.operand(parts.pop())
        while kinds:
            out = [*self.operand(parts.pop()), sql(kinds.pop().upper()), Group(out)]
        return [*out, *(self.tail(tail) if tail else [])]

    def operand(self, items: list[Node]) -> list[Node]:
        if len(items) == 1 and isinstance(items[0], Group):
            return [Group(self.query(items[0].items))]
        return self.select(items)

    def tail(self, items: list[Node]) -> list[Node]:
        at = find(items, "order", "by")
        if at < 0:
            return self.expr(items)
        end = min((k for k in (find(items, "limit"), find(items, "offset")) if k > at), default=len(items))
        return [*self.expr(items[:at]), sql("ORDER BY"), *self.keys(items[at + 2 : end]), *self.expr(items[end:])]

    def keys(self, items: list[Node]) -> list[Node]:
        """Sort keys with the null order spelled out: last when ascending, first when descending."""
        out: list[Node] = []
        for part in split(items):
            key = self.expr(part)
            if find(part, "nulls") < 0:
                key.append(sql("NULLS FIRST" if part[-1].word() == "desc" else "NULLS LAST"))
            out += [Token("op", ","), *key] if out else key
        return out

    def with_(self, items: list[Node]) -> list[Node]:
        recursive = items[1].word() == "recursive"
        i, out = 1 + recursive, []
        while True:
            name, i = items[i], i + 1
            columns = None
            if isinstance(items[i], Group):
                columns, i = items[i], i + 1
            if items[i].word() != "as":
                raise DialectError("AS is expected in WITH")
            body, i = items[i + 1], i + 2
            text = self.cte(name, columns, body.items) if recursive and name.text in words(body.items) else None
            if text is None:
                out.append([name, *([columns] if columns else []), sql("AS"), Group(self.query(body.items))])
            elif text:
                out.append([name, sql(text)])
            if i < len(items) and is_op(items[i], ","):
                i += 1
                continue
            break
        rest = self.query(items[i:])
        if not out:
            return rest
        joined: list[Node] = []
        for k, one in enumerate(out):
            joined += [Token("op", ","), *one] if k else one
        return [sql("WITH RECURSIVE" if recursive else "WITH"), *joined, *rest]

    def cte(self, name: Token, columns: Group | None, body: list[Node]) -> str | None:
        """Checks a recursive query's shape; with UNION, its rows come from a fixpoint ('' where they are a view)."""
        at = [k for k, x in enumerate(body) if x.word() == "union"]
        if len(at) != 1:
            raise DialectError(f"{name.text}: a recursive query is an anchor, UNION or UNION ALL, and one step")
        every = body[at[0] + 1].word() == "all"
        anchor, step = body[: at[0]], body[at[0] + 1 + every :]
        if name.text in words(anchor):
            raise DialectError(f"{name.text}: the anchor refers to itself")
        if references(step, name.text) != 1:
            raise DialectError(f"{name.text}: the step must refer to {name.text} exactly once")
        if every:
            return None
        names = [render([c]) for part in split(columns.items) for c in part] if columns else []
        self.context.recursive(name.text, names, render(self.query(anchor)), render(self.query(step)))
        return ""

    def clauses(self, items: list[Node]) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        now = ""
        for k, x in enumerate(items):
            w = x.word()
            if w in _CLAUSES and not (w == "from" and k and items[k - 1].word() == "distinct") and not (k and is_op(items[k - 1], ".")):
                now = w
                out[now] = []
            elif now:
                out[now].append(x)
            else:
                raise DialectError(f"not a query: {render(items)[:60]}")
        return out

    def select(self, items: list[Node]) -> list[Node]:
        if not items or items[0].word() != "select":
            return self.expr(items)
        c = self.clauses(items)
        self.tables = [*getattr(self, "tables", []), self.first_table(c.get("from", []))]
        try:
            return self.assembled(c)
        finally:
            self.tables = self.tables[:-1]

    def assembled(self, c: dict[str, list[Node]]) -> list[Node]:
        chosen = c["select"]
        on = None
        if len(chosen) > 2 and chosen[0].word() == "distinct" and chosen[1].word() == "on":
            on, chosen = chosen[2].items, chosen[3:]
        source = self.source(c["from"]) if "from" in c else []
        inner: list[str] = []
        if "group" not in c and "having" not in c and self.special(chosen):
            levels: tuple[list[str], list[str]] = ([], [])
            chosen = self.windows(chosen, inner, levels)
        out: list[Node] = []
        if inner:
            alias = self.alias(c["from"])
            where = [sql("WHERE"), *self.expr(c["where"])] if "where" in c else []
            source = [Group([sql("SELECT *, " + ", ".join(inner) + " FROM"), *source, *where]), sql(alias)]
            for name, texts in zip("ip", levels):
                if texts:
                    source = [Group([sql("SELECT *, " + ", ".join(f"{x} AS __{name}{k}" for k, x in enumerate(texts)) + " FROM"), *source]), sql(alias)]
        listed = self.expr(chosen)
        if on is not None:
            return self.distinct_on(on, listed, source, c)
        out = [sql("SELECT"), *listed]
        if source:
            out += [sql("FROM"), *source]
        if "where" in c and not inner:
            out += [sql("WHERE"), *self.expr(c["where"])]
        if "group" in c:
            out += [sql("GROUP"), *self.expr(c["group"])]
        if "having" in c:
            out += [sql("HAVING"), *self.expr(c["having"])]
        if "order" in c:
            out += [sql("ORDER BY"), *self.keys(c["order"][1:])]
        for k in ("limit", "offset"):
            if k in c:
                out += [sql(k.upper()), *self.expr(c[k])]
        return out

    def distinct_on(self, keys: list[Node], listed: list[Node], source: list[Node], c: dict[str, list[Node]]) -> list[Node]:
        """The first row of each key; the ORDER BY must begin with the keys."""
        by = split(keys)
        order = split(c["order"][1:]) if "order" in c else []
        for k, o in zip(by, order):
            if render(o[: len(k)]).lower() not in {render(x).lower() for x in by}:
                raise DialectError("DISTINCT ON keys must come first in ORDER BY")
        names, items = [], []
        for k, item in enumerate(split(listed)):
            at = find(item, "as")
            last = item[-1]
            plain = len(item) == 1 or len(item) == 3 and is_op(item[1], ".")
            name = render([last]) if (at >= 0 or plain) and isinstance(last, Token) and last.kind in ("name", "quoted") else f"column{k + 1}"
            names.append(name)
            items.append(f"{render(item[:at] if at >= 0 else item)} AS {name}")
        parted = render([y for k, x in enumerate(by) for y in ([Token("op", ","), *self.expr(x)] if k else self.expr(x))])
        ordered = render(self.keys(c["order"][1:])) if order else parted
        text = f"SELECT {', '.join(names)} FROM (SELECT {', '.join(items)}, row_number() OVER (PARTITION BY {parted} ORDER BY {ordered}) AS __n FROM {render(source)}"
        text += f" WHERE {render(self.expr(c['where']))}" if "where" in c else ""
        tail = "".join(f" {k.upper()} {render(self.expr(c[k]))}" for k in ("limit", "offset") if k in c)
        return [sql(f"{text}) WHERE __n = 1{tail}")]

    # --- sources

    def first_table(self, items: list[Node]) -> str | None:
        return items[0].text if items and isinstance(items[0], Token) and items[0].kind in ("name", "quoted") else None

    def alias(self, items: list[Node]) -> str:
        """The name by which a FROM with one source is known."""
        if any(is_op(x, ",") or x.word() in ("join", "lateral", "apply") for x in items):
            raise DialectError("GROUPS and EXCLUDE frames are for queries of one source; put the join in a subquery")
        last = items[-1]
        return render([last]) if isinstance(last, Token) and last.kind in ("name", "quoted") else "__source"

    def source(self, items: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(items):
            x, w = items[i], items[i].word()
            nxt = items[i + 1].word() if i + 1 < len(items) else ""
            if w in ("cross", "outer") and nxt == "apply":
                out.append(sql("CROSS JOIN LATERAL" if w == "cross" else "LEFT JOIN LATERAL"))
                body, i = self.source_item(items, i + 2, out)
                out += body
                if w == "outer":
                    if i < len(items) and items[i].word() == "as":
                        i += 1
                    if i < len(items) and items[i].kind in ("name", "quoted") and items[i].word() not in ("where", "left", "right", "inner", "cross", "outer", "join", "full", "on"):
                        out.append(items[i])
                        i += 1
                    out.append(sql("ON TRUE"))
            elif w in GRAPH_CALLS or isinstance(x, Group):
                body, i = self.source_item(items, i, out)
                out += body
            elif w == "on":
                end = next((k for k in range(i + 1, len(items)) if is_op(items[k], ",") or items[k].word() in ("join", "left", "right", "inner", "cross", "outer", "full", "natural")), len(items))
                while end < len(items) and items[end].word() in ("left", "right") and end + 1 < len(items) and isinstance(items[end + 1], Group):
                    end = next((k for k in range(end + 1, len(items)) if items[k].word() in ("join", "left", "right", "inner", "cross", "full")), len(items))
                out += [sql("ON"), *self.expr(items[i + 1 : end])]
                i = end
            else:
                out.append(x)
                i += 1
        return out

    def source_item(self, items: list[Node], i: int, before: list[Node]) -> tuple[list[Node], int]:
        x = items[i]
        if x.word() in GRAPH_CALLS:
            args = split(items[i + 1].items)
            lateral = bool(before) and isinstance(before[-1], Token) and before[-1].text.upper().endswith("LATERAL")
            outer = [k for k, a in enumerate(args) if len(a) == 3 and is_op(a[1], ".") or len(a) == 1 and a[0].kind == "name" and a[0].word() not in ("null", "true", "false") and k]
            if lateral and outer:
                return [Group([sql(self.lateral_graph(x.word(), args, outer, before))])], i + 2
            values = [self.value(a) for a in args]
            return [sql(self.context.graph(x.word(), values))], i + 2
        if isinstance(x, Group):
            if x.items and x.items[0].word() in ("select", "with"):
                return [Group(self.query(x.items))], i + 1
            return [Group(self.source(x.items))], i + 1
        return [x], i + 1

    def lateral_graph(self, name: str, args: list[list[Node]], outer: list[int], before: list[Node]) -> str:
        """A graph function whose node comes from the row outside: grown for all rows at once, then looked up."""
        if name != "graph_expand" or outer != [2]:
            raise DialectError("a lateral graph function is graph_expand with the node's id from outside")
        node = render(self.expr(args[2]))
        table = [t for t in before[:-1] if isinstance(t, Token) and t.word() not in ("cross", "join", "left", "inner")]
        values = [None if k == 2 else self.value(a) for k, a in enumerate(args)]
        view = self.context.graph(name, values, f"SELECT DISTINCT CAST({node} AS string) AS node_id FROM {render(table)}")
        return f"SELECT * FROM {view} WHERE {view}.start = CAST({node} AS string)"

    def value(self, items: list[Node]) -> object:
        """The value of a literal or parameter."""
        if len(items) == 1 and isinstance(items[0], Token):
            x = items[0]
            if x.kind == "string":
                return string_of(x)
            if x.kind == "number":
                return float(x.text) if "." in x.text else int(x.text)
            if x.kind == "param":
                n = int(x.text[1:])
                return self.args[n - 1] if self.args and n <= len(self.args) else None
            if x.word() in ("null", "true", "false"):
                return {"null": None, "true": True, "false": False}[x.word()]
            if x.kind in ("name", "quoted"):
                return x.text.strip("`")
        raise DialectError(f"a literal is expected, not {render(items)}")

    # --- expressions

    def expr(self, items: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(items):
            x = items[i]
            if isinstance(x, Group):
                head = x.items[0].word() if x.items else ""
                if head in ("select", "with"):
                    out.append(Group(self.query(x.items)))
                elif out and out[-1].word() == "over":
                    out.append(Group(self.frame(x.items)))
                else:
                    out.append(Group(self.expr(x.items)))
            elif x.kind == "param":
                out.append(sql(self.param(int(x.text[1:]))))
            elif x.kind == "name" and x.word() not in _NO_CALLS and i + 1 < len(items) and isinstance(items[i + 1], Group) and not (out and is_op(out[-1], ".")):
                out += self.call(x, items[i + 1])
                i += 1
            elif x.kind == "name" and x.word() in ("current_user", "session_user", "current_role") and (value := self.context.session(x.word(), [])) is not None:
                out.append(sql(value))
            elif is_op(x, "::"):
                kind = items[i + 1]
                size = items[i + 2] if i + 2 < len(items) and isinstance(items[i + 2], Group) and kind.word() in ("varchar", "char", "numeric", "decimal", "vector") else None
                left = self.left(out)
                plain = size is None and kind.word() != "vector"
                out.append(sql(f"{render(left)}::{_TYPES.get(kind.word(), kind.text)}" if plain else self.cast(render(left), kind.word(), render(size.items) if size else None)))
                i += 1 + (size is not None)
            elif is_op(x, "<->", "<#>", "<=>"):
                left = self.left(out)
                right, i = self.right(items, i + 1)
                out.append(sql(self.vectors(_VECTOR[x.text], self.vector(left), self.vector(right))))
                continue
            elif x.word() == "like":
                negate = bool(out) and out[-1].word() == "not"
                if negate:
                    out.pop()
                left = self.left(out)
                while out and is_op(out[-1], "||", "+", "-", "*", "/"):
                    op = out.pop()
                    left = [*self.left(out), op, *left]
                left = [Group(left)] if len(left) > 1 and any(is_op(x, "||", "+", "-", "*", "/") for x in left) else left
                raw = items[i + 1]
                if isinstance(raw, Token) and raw.kind == "string":
                    text, i = like(render(left), string_of(raw)), i + 2
                else:
                    right, i = self.right(items, i + 1)
                    text = like_any(render(left), render(right))
                out.append(sql(f"(NOT {text})" if negate else f"({text})"))
                continue
            else:
                out.append(x)
            i += 1
        return out

    def param(self, n: int) -> str:
        """Parameters count from 1; one that is not given is NULL."""
        if self.args is None or n > len(self.args) or n < 1:
            return "NULL"
        self.used.add(n)
        return f":p{n}"

    def left(self, out: list[Node]) -> list[Node]:
        """Takes the operand that ends a list."""
        taken: list[Node] = []
        while out:
            x = out[-1]
            operand = isinstance(x, Group) or x.kind in ("name", "quoted", "string", "number", "sql")
            if not taken and operand or taken and (is_op(x, ".") or is_op(taken[0], ".") or isinstance(taken[0], Group) and isinstance(x, Token) and x.kind == "name" and x.word() not in ("and", "or", "not", "in", "when", "then", "else", "case", "where", "on", "by", "having", "between", "is", "like", "select", "distinct")):
                taken.insert(0, out.pop())
            elif is_op(x, "]"):
                while out and not is_op(out[-1], "["):
                    taken.insert(0, out.pop())
                taken.insert(0, out.pop())
            else:
                break
        if not taken:
            raise DialectError("an operand is missing")
        return taken

    def right(self, items: list[Node], i: int) -> tuple[list[Node], int]:
        """The operand that begins at a place, rewritten, and the place after it."""
        end = i
        if end < len(items) and is_op(items[end], "-"):
            end += 1
        if end < len(items) and is_op(items[end], "["):
            while end < len(items) and not is_op(items[end], "]"):
                end += 1
        end += 1
        while end < len(items) and (is_op(items[end], ".", "::") or is_op(items[end - 1], ".", "::") or isinstance(items[end], Group) and items[end - 1].kind == "name"):
            end += 1
        return self.expr(items[i:end]), end

    def vector(self, operand: list[Node]) -> str:
        """An operand as an array; a string literal holds one in brackets."""
        if len(operand) == 1 and isinstance(operand[0], Token) and operand[0].kind == "string":
            parts = string_of(operand[0]).strip().strip("[]").split(",")
            return "array(" + ", ".join(f"{float(p)!r}D" for p in parts) + ")"
        if is_op(operand[0], "["):
            return f"array({', '.join(f'cast({render(p)} AS double)' for p in split(operand[1:-1]))})"
        if len(operand) == 1 and isinstance(operand[0], Token) and operand[0].kind == "sql" and operand[0].text.startswith(":p"):
            n = int(operand[0].text[2:])
            given = self.args[n - 1]
            if isinstance(given, str):
                self.used.discard(n)
                return self.vector([Token("string", "'" + given + "'")])
        return f"cast({render(operand)} AS array<double>)"

    def vectors(self, form: str, a: str, b: str) -> str:
        """A measure of two vectors; different lengths are an error."""
        value = form.format(a="v.a", b="v.b")
        checked = f"CASE WHEN size(v.a) = size(v.b) THEN {value} WHEN v.a IS NOT NULL AND v.b IS NOT NULL THEN cast(raise_error('vectors differ in length') AS double) END"
        return f"transform(array(named_struct('a', {a}, 'b', {b})), v -> {checked})[0]"

    def cast(self, value: str, kind: str, size: str | None = None) -> str:
        if kind == "vector":
            return f"cast({value} AS array<double>)"
        if kind in ("varchar", "char") and size:
            s = f"cast({value} AS string)"
            return f"(CASE WHEN length({s}) <= {size} THEN {s} WHEN {s} IS NOT NULL THEN raise_error('value too long for {kind}({size})') END)"
        return f"cast({value} AS {_TYPES.get(kind, kind)})"

    # --- calls

    def call(self, name: Token, group: Group) -> list[Node]:
        f = name.word()
        if f == "cast":
            at = find(group.items, "as")
            if at >= 0:
                kind = group.items[at + 1]
                size = render(group.items[at + 2].items) if len(group.items) > at + 2 and isinstance(group.items[at + 2], Group) else None
                if kind.word() in _TYPES or kind.word() in ("varchar", "char", "vector"):
                    return [sql(self.cast(render(self.expr(group.items[:at])), kind.word(), size))]
                return [name, Group([*self.expr(group.items[:at]), *group.items[at:]])]
            value, kind = split(group.items)
            return [sql(self.cast(render(self.expr(value)), string_of(kind[0]).lower()))]
        raw = split(group.items)
        if f in ("search", "search_score", "snippet") and len(raw) == 2:
            field, query = render(self.expr(raw[0])), self.value(raw[1])
            if f == "snippet":
                return [sql(self.context.snippet(field, str(query or "")))]
            if f == "search":
                return [sql(self.context.match(field, str(query or "")))]
            return [sql(self.context.score(self.tables[-1] if self.tables else None, field, str(query or "")))]
        if f in _VECTOR_CALLS:
            a, b = (self.vector(self.expr(x)) for x in raw)
            return [sql(self.vectors(_VECTOR_CALLS[f], a, b))]
        args = [self.expr(x) for x in raw]
        text = [render(a) for a in args]
        if f == "time_bucket":
            return [sql(bucket(string_of(raw[0][0]), text[1], text[2] if len(text) > 2 else "TIMESTAMP'1970-01-01'"))]
        if f == "concat":
            return [sql(f"concat_ws('', {', '.join(text)})")]
        if f == "len":
            return [sql(f"length({text[0]})")]
        if f in ("substring", "substr") and len(text) in (2, 3):
            return [sql(f"substring({text[0]}, greatest({text[1]}, 1)" + (f", CASE WHEN {text[2]} < 0 THEN cast(raise_error('negative length') AS int) ELSE {text[2]} END)" if len(text) == 3 else ")"))]
        if f == "hybrid_score":
            return [sql(f"round(0.65D * ({text[0]}) + 0.35D * ({text[1]}), 12)")]
        if f == "quote_ident":
            from quillmark.functions.scalar import RESERVED

            plain = f"rlike({text[0]}, '^[a-z_][a-z0-9_]*$') AND {text[0]} NOT IN ({', '.join(map(quote, sorted(RESERVED)))})"
            return [sql(f"(CASE WHEN {plain} THEN {text[0]} ELSE concat('\"', replace({text[0]}, '\"', '\"\"'), '\"') END)")]
        if f == "format_type":
            from quillmark.functions.scalar import TYPE_NAMES

            names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TYPE_NAMES.items())
            name_ = f"(CASE {text[0]} {names} ELSE '???' END)"
            if len(text) == 1 or text[1].lower() == "null":
                return [sql(name_)]
            return [sql(f"(CASE WHEN {text[0]} IN (1042, 1043) AND {text[1]} > 4 THEN concat({name_}, '(', cast({text[1]} - 4 AS string), ')') ELSE {name_} END)")]
        literals = [string_of(a[0]) if len(a) == 1 and isinstance(a[0], Token) and a[0].kind == "string" else render(a) for a in raw]
        value = self.context.session(f, literals)
        if value is not None:
            return [sql(value)]
        joined: list[Node] = []
        for k, a in enumerate(args):
            joined += [Token("op", ","), *a] if k else a
        return [name, Group(joined)]

    # --- windows

    def frame(self, items: list[Node]) -> list[Node]:
        at = find(items, "order", "by")
        if at < 0:
            return self.expr(items)
        end = next((k for k in range(at, len(items)) if items[k].word() in ("rows", "range", "groups")), len(items))
        return [*self.expr(items[:at]), sql("ORDER BY"), *self.keys(items[at + 2 : end]), *items[end:]]

    def special(self, items: list[Node]) -> bool:
        return any(isinstance(x, Group) and k and items[k - 1].word() == "over" and any(y.word() in ("groups", "exclude") for y in x.items) for k, x in enumerate(items))

    def windows(self, items: list[Node], inner: list[str], levels: tuple[list[str], list[str]]) -> list[Node]:
        """Replaces windows with GROUPS or EXCLUDE; ``inner`` gets the numbers of peers and rows they need, ``levels`` what they share above these."""
        out: list[Node] = []
        i = 0
        while i < len(items):
            over = items[i + 2] if i + 3 < len(items) and items[i + 2].word() == "over" else None
            spec = items[i + 3] if over else None
            if over and isinstance(items[i + 1], Group) and isinstance(spec, Group) and any(y.word() in ("groups", "exclude") for y in spec.items):
                out.append(sql(self.window(items[i].word(), render(self.expr(items[i + 1].items)), spec.items, inner, levels)))
                i += 4
            else:
                out.append(items[i])
                i += 1
        return out

    def window(self, kind: str, value: str, spec: list[Node], inner: list[str], levels: tuple[list[str], list[str]]) -> str:
        from quillmark.operators.windows import pick

        if kind not in ("first_value", "last_value", "min"):
            raise DialectError(f"{kind} takes no GROUPS or EXCLUDE frame")
        at = find(spec, "order", "by")
        unit_at = next(k for k in range(len(spec)) if spec[k].word() in ("rows", "range", "groups"))
        unit = spec[unit_at].word()
        parted = render(self.expr(spec[2 : at if at >= 0 else unit_at])) if spec[0].word() == "partition" else ""
        order = render(self.keys(spec[at + 2 : unit_at])) if at >= 0 else "1"
        rest = spec[unit_at + 1 :]
        ex = find(rest, "exclude")
        exclude = " ".join(x.word() for x in rest[ex + 1 :]) if ex >= 0 else "no others"
        bounds = rest[:ex] if ex >= 0 else rest
        if bounds and bounds[0].word() == "between":
            mid = find(bounds, "and")
            low, high = bound(bounds[1:mid]), bound(bounds[mid + 1 :])
        else:
            low, high = bound(bounds), 0
        over = f"({'PARTITION BY ' + parted + ' ' if parted else ''}ORDER BY {order})"
        # Windows of one order share its numbers, so Spark sorts once for all that look at the same ones.
        ranked = f"dense_rank() OVER {over} AS __g"
        same = next((x.removeprefix(ranked) for x in inner if x.startswith(ranked)), None)
        if same is None:
            self.numbers += 1
            same = str(self.numbers)
            inner += [f"{ranked}{same}", f"row_number() OVER {over} AS __r{same}"]
        g, r = f"__g{same}", f"__r{same}"
        return pick(kind, value, parted, order, g, r, unit, low, high, exclude, levels)


def bound(items: list[Node]) -> int | None:
    """An offset of rows or groups: negative before, positive after, None where unbounded."""
    w = [x.word() or x.text for x in items]
    if w[0] == "unbounded":
        return None
    if w[0] == "current":
        return 0
    n = int(w[0])
    return -n if w[1] == "preceding" else n


def references(items: list[Node], name: str) -> int:
    """How often a tree names a table after FROM, JOIN or a comma."""
    n = 0
    for k, x in enumerate(items):
        if isinstance(x, Group):
            n += references(x.items, name)
        elif x.kind in ("name", "quoted") and x.text.strip("`") == name and k and (items[k - 1].word() in ("from", "join") or is_op(items[k - 1], ",")) and not (k + 1 < len(items) and is_op(items[k + 1], ".")):
            n += 1
    return n


def like(value: str, pattern: str) -> str:
    """LIKE without regard to case, in which % counts at the ends only."""
    p = pattern.lower()
    start, end = p.startswith("%"), p.endswith("%") and len(p) > 1
    inner, x = quote(p[start : len(p) - end]), f"lower({value})"
    if start and end:
        return f"contains({x}, {inner})"
    if start:
        return f"endswith({x}, {inner})"
    return f"startswith({x}, {inner})" if end else f"{x} = {inner}"


def like_any(value: str, pattern: str) -> str:
    """LIKE by a pattern that is not known before the query runs."""
    x, p = f"lower({value})", f"lower({pattern})"
    body = f"substring({p}, IF(startswith({p}, '%'), 2, 1), greatest(length({p}) - IF(startswith({p}, '%'), 1, 0) - IF(endswith({p}, '%') AND length({p}) > 1, 1, 0), 0))"
    return f"CASE WHEN startswith({p}, '%') AND endswith({p}, '%') AND length({p}) > 1 THEN contains({x}, {body}) WHEN startswith({p}, '%') THEN endswith({x}, {body}) WHEN endswith({p}, '%') AND length({p}) > 1 THEN startswith({x}, {body}) ELSE {x} = {p} END"


def bucket(width: str, ts: str, origin: str) -> str:
    at, o = f"unix_micros(cast({ts} AS timestamp))", f"unix_micros(cast({origin} AS timestamp))"
    return f"cast(timestamp_micros({at} - pmod({at} - {o}, {micros(width)})) AS timestamp_ntz)"


def translate(text: str) -> str:
    """Spark SQL of a query that needs no session."""
    return rewrite(text)[0]


def rewrite(text: str, context: Context | None = None, args: list | None = None) -> tuple[str, dict]:
    """Spark SQL of a query and its named arguments."""
    r = Rewriter(context, args)
    items = parse(text.strip().rstrip(";"))
    out = render(r.query(items))
    return out, {f"p{n}": args[n - 1] for n in r.used} if args else {}


def names_in(text: str) -> set[str]:
    """All words of a statement that may name a table."""
    return words(parse(text))
