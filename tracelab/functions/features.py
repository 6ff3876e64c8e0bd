"""Features of program text, by tokenizer and syntax tree in Arrow batches: parsed, never executed."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AVERAGES = {"sma": "SMA", "simplemovingaverage": "SMA", "ema": "EMA", "exponentialmovingaverage": "EMA", "wma": "WMA", "weightedmovingaverage": "WMA"}
COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "=="}
OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}
TURN = {">": "<", ">=": "<=", "<": ">", "<=": ">=", "==": "=="}


def sanitize(text: str) -> str | None:
    """Comments and string payloads blanked, numeric strings kept; null for what can't be tokenized."""
    out, last = [], (1, 0)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            body = t.string
            if t.type == tokenize.COMMENT:
                body = ""
            elif t.type == tokenize.STRING and not re.fullmatch(r"[rbuRBU]*(['\"])\s*[-+]?\d+(\.\d+)?\s*\1", body):
                body = "''"
            if t.start[0] > last[0]:
                out.append("\n" * (t.start[0] - last[0]) + " " * t.start[1])
            elif t.start[1] > last[1]:
                out.append(" " * (t.start[1] - last[1]))
            out.append(body)
            last = t.end
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return None
    return "".join(out)


def _name(node: ast.AST) -> str | None:
    """x, or self.x; null for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
        return f"self.{node.attr}"
    return None


def _literal(node: ast.AST) -> float | None:
    """A number, negated or written as Decimal("...") too."""
    match node:
        case ast.Constant(value=bool()):
            return None
        case ast.Constant(value=int() | float()):
            return float(node.value)
        case ast.UnaryOp(op=ast.USub()):
            inner = _literal(node.operand)
            return None if inner is None else -inner
        case ast.Call(func=ast.Name(id="Decimal") | ast.Attribute(attr="Decimal"), args=[ast.Constant(), *_]):
            try:
                return float(str(node.args[0].value))
            except ValueError:
                return None
    return None


def constants(tree: ast.AST) -> dict[str, float]:
    """Names, and attributes of self under self.<name>, whose plain assignments of a number all agree. A plain name also
    answers for the attribute where nothing is ever assigned to that, as a class's attributes do. Assignments of other
    things than numbers, and x += 1, don't count against a plain name: they are as lax as a reader without execution
    must be."""
    values: dict[str, set[float]] = {}
    touched: set[str] = set()
    for node in ast.walk(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign | ast.AugAssign) else []
        names = [n for n in map(_name, targets) if n]
        touched.update(n for n in names if "." in n)
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and names and (v := _literal(node.value)) is not None:
            values.setdefault(names[0], set()).add(v)
    table = {n: v.pop() for n, v in values.items() if len(v) == 1}
    return {f"self.{n}": v for n, v in table.items() if "." not in n and f"self.{n}" not in touched} | table


def _number(node: ast.AST, table: dict[str, float]) -> float | None:
    value = _literal(node)
    return table.get(_name(node) or "") if value is None else value


def _leaves(body: list[ast.stmt]) -> bool:
    """A guard's body: it only leaves, and returns nothing."""
    return bool(body) and all(isinstance(x, ast.Continue | ast.Pass) or (isinstance(x, ast.Return) and x.value is None) for x in body)


def tests_of(tree: ast.AST, word: str, table: dict[str, float], turn_guards: bool = False) -> set[tuple[str, float]]:
    """(comparator, number) of all comparisons of something named with word against a number, as <word> <op> number. With
    turn_guards, the test of a guard that only leaves says the opposite: the rule that follows it."""
    guards = {id(n.test) for n in ast.walk(tree) if turn_guards and isinstance(n, ast.If) and _leaves(n.body) and not n.orelse}
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
            a, b, op = node.left, node.comparators[0], COMPARE[type(node.ops[0])]
            if word in ast.unparse(b).lower() and word not in ast.unparse(a).lower():
                a, b, op = b, a, TURN[op]
            if word in ast.unparse(a).lower() and (v := _number(b, table)) is not None:
                out.add((OPPOSITE.get(op, op) if id(node) in guards else op, v))
    return out


def extract(text: str | None) -> tuple[str, str | None, float | None, str | None, float | None]:
    """(status, average kind, its period, comparator of an RSI test, its threshold); several distinct values are
    unresolved, `not` and mirrored comparisons are normalised to rsi <op> number."""
    clean = sanitize(text) if text else None
    if clean is None:
        return "unlexable", None, None, None, None
    try:
        tree = ast.parse(clean)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "unparsable", None, None, None, None
    table, kinds, periods = constants(tree), set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            name = (f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else "").lower()
            if name in AVERAGES:
                kinds.add(AVERAGES[name])
                args = [*node.args, *(k.value for k in node.keywords if k.arg and "period" in k.arg.lower())]
                periods |= {v for v in (_number(a, table) for a in args) if v is not None and 1 < v < 1000}
    tests = tests_of(tree, "rsi", table)
    one = lambda s: next(iter(s)) if len(s) == 1 else None
    ops = {o for o, _ in tests}
    return ("ok" if len(kinds) <= 1 and len(periods) <= 1 and len(tests) <= 1 else "unresolved"), one(kinds), one(periods), one(ops) or ("mixed" if ops else None), one({v for _, v in tests})


# ---------------------------------------------------------------- settings

# The names that an engine's interface gives to what a setting says, in lower case without underlines.
SMOOTHING = {"simple": "simple", "exponential": "ema", "wilders": "wilder"}
NORMALIZATION = {"raw": "raw", "splitadjusted": "split_adjusted", "totalreturn": "total_return"}
HELD = {"invested", "quantity", "holdstock", "islong"}
LOTS = ("shares", "lot", "holding", "position", "qty", "units")
BEFORE = ("prev", "last", "yesterday")


class Facts(ast.NodeVisitor):
    """What one walk over a program finds; names are in lower case without underlines."""

    def __init__(self, tree: ast.AST):
        self.calls: list[tuple[str, ast.Call]] = []
        self.attributes: set[tuple[str, str]] = set()
        self.names: set[str] = set()
        self.held = False
        self.compares: list[ast.Compare] = []
        self.zeroed: set[str] = set()
        self.ifs: list[ast.If] = []
        self.functions: dict[str, ast.FunctionDef] = {}
        self.sums: list[ast.BinOp] = []
        self.visit(tree)

    def visit(self, node: ast.AST) -> None:
        match node:
            case ast.Call():
                self.calls.append((flat(node.func).rsplit(".", 1)[-1], node))
            case ast.Attribute():
                self.attributes.add((flat(node.value).rsplit(".", 1)[-1], plain(node.attr)))
                self.names.add(plain(node.attr))
                self.held |= isinstance(node.value, ast.Subscript) and "portfolio" in flat(node.value.value) and plain(node.attr) in HELD
            case ast.Name():
                self.names.add(plain(node.id))
            case ast.Compare():
                self.compares.append(node)
            case ast.If():
                self.ifs.append(node)
            case ast.FunctionDef():
                self.functions[node.name] = node
            case ast.BinOp():
                self.sums.append(node)
            case ast.Assign(value=ast.Constant(value=0 | False)):
                self.zeroed.update(flat(t) for t in node.targets)
        self.generic_visit(node)

    def called(self, *names: str) -> list[ast.Call]:
        return [c for n, c in self.calls if n in names]


def plain(name: str) -> str:
    return name.lower().replace("_", "")


def flat(node: ast.AST) -> str:
    return plain(ast.unparse(node))


def mentions(node: ast.AST, words: tuple[str, ...]) -> bool:
    return any(w in flat(node) for w in words)


def is_average(text: str) -> bool:
    return any(w in text for w in ("sma", "ema", "wma", "movingaverage", "average")) or text in ("ma", "self.ma") or text.startswith(("ma[", "self.ma["))


def _smoothing(f: Facts) -> str:
    named = [SMOOTHING[b] for a, b in sorted(f.attributes) if a == "movingaveragetype" and b in SMOOTHING]
    if named:
        return named[0]
    if f.called("rsi", "relativestrengthindex"):
        return "wilder"
    gains = ("gain", "loss")
    for x in f.sums:  # (mean * (n - 1) + now) / n
        if isinstance(x.op, ast.Div) and isinstance(x.left, ast.BinOp) and isinstance(x.left.op, ast.Add):
            inner = [y for y in ast.walk(x.left) if isinstance(y, ast.BinOp) and isinstance(y.op, ast.Mult)]
            if any(isinstance(z, ast.BinOp) and isinstance(z.op, ast.Sub) and _literal(z.right) == 1 for y in inner for z in (y.left, y.right)):
                return "wilder"
    if f.called("ewm") or any(isinstance(x.op, ast.Mult) and mentions(x, gains) and any(isinstance(z, ast.BinOp) and isinstance(z.op, ast.Sub) and _literal(z.left) == 1 for z in (x.left, x.right)) for x in f.sums):
        return "ema"
    return "simple" if any(mentions(c, gains) for c in f.called("sum", "mean", "rolling")) else "unresolved"


def _reads_readiness(node: ast.AST, f: Facts) -> bool:
    for x in ast.walk(node):
        if isinstance(x, ast.Attribute) and plain(x.attr) == "isready" or isinstance(x, ast.Call) and flat(x.func) == "len":
            return True
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in f.functions and f.functions[x.func.attr] is not node and _reads_readiness(f.functions[x.func.attr], Facts(ast.Module([], []))):
            return True
    return False


def _warmup(f: Facts) -> tuple[str, str | None]:
    if calls := f.called("setwarmup"):
        return "strict", ast.unparse(calls[0].args[0])[:40] if calls[0].args else None
    short = any(isinstance(c.ops[0], ast.Lt) and isinstance(c.left, ast.Call) and flat(c.left.func) == "len" for c in f.compares)
    if "isready" not in f.names and not short:
        return "none", None
    for name, body in ((n, d.body) for n, d in f.functions.items() if plain(n) == "ondata"):
        if any(isinstance(x, ast.If) and _reads_readiness(x.test, f) and any(isinstance(y, ast.Return) for y in ast.walk(x)) for x in body):
            return "ready_check", None
    return "ready_per_rule", None


def _execution(f: Facts) -> str:
    target, order, total = f.called("setholdings"), f.called("marketorder"), "totalportfoliovalue" in f.names
    cash = ("portfolio", "cash") in f.attributes
    if target and not (total and order):
        return "set_holdings"
    if total and order:
        return "calc_shares"
    return "pct_cash" if cash and order and any(isinstance(x.op, ast.Mult) and mentions(x, ("portfolio.cash",)) for x in f.sums) else "unresolved"


def _sells(body: list[ast.stmt]) -> bool:
    calls = Facts(ast.Module(body, [])).calls
    return any(n in ("liquidate", "sell") or n == "marketorder" and any(isinstance(a, ast.UnaryOp) and isinstance(a.op, ast.USub) for a in c.args) for n, c in calls)


def _buys(body: list[ast.stmt]) -> bool:
    calls = Facts(ast.Module(body, [])).calls
    return any(n in ("setholdings", "buy") or n == "marketorder" and not any(isinstance(a, ast.UnaryOp) for a in c.args) for n, c in calls)


def _reentry(f: Facts) -> str:
    dated = any(n.startswith(("lastaction", "lasttrade", "lastsell", "lastexit")) and n.endswith(("bar", "date", "day", "time")) or n in ("soldtoday", "selltoday", "soldthisbar", "sellthisbar") for n in f.names)
    if f.held or dated or any(_sells(x.body) and _buys(x.orelse) for x in f.ifs):
        return "wait_bar"
    own = lambda text: any(w in text for w in (*LOTS, "long"))
    gates = {flat(c.left) for c in f.compares if isinstance(c.ops[0], ast.Eq | ast.LtE | ast.Is) and isinstance(c.comparators[0], ast.Constant) and not c.comparators[0].value}
    gates |= {flat(y.operand) for x in f.ifs for y in ast.walk(x.test) if isinstance(y, ast.UnaryOp) and isinstance(y.op, ast.Not)}
    return "allowed" if any(own(g) for g in gates) and any(own(z) for z in f.zeroed) else "unresolved"


def _rsi_exit(f: Facts, tree: ast.AST) -> str:
    names = {"rsi"} | {flat(t) for n in ast.walk(tree) if isinstance(n, ast.Assign) and "rsi" in flat(n.value) for t in n.targets}
    is_rsi = lambda node: any(n in flat(node) for n in names)
    for node in ast.walk(tree):
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            parts = [c for c in node.values if isinstance(c, ast.Compare) and is_rsi(c.left)]
            old = [c for c in parts if isinstance(c.ops[0], ast.Lt | ast.LtE) and (mentions(c.left, BEFORE) or flat(c.left).endswith("[1]"))]
            if old and any(isinstance(c.ops[0], ast.Gt | ast.GtE) for c in parts if c not in old):
                return "cross"
    return "level" if any("rsi" in n for n in f.names) else "unresolved"


def _timing(f: Facts, tree: ast.AST) -> str:
    averages = {n for n in f.names if is_average(n)}
    indexed = any(isinstance(x, ast.Subscript) and is_average(flat(x.value)) and _literal(x.slice) == 1 for x in ast.walk(tree))
    if indexed or "previous" in f.names or any(b in n for n in averages for b in BEFORE):
        return "both_days"
    return "today_ma" if averages else "unresolved"


def _directions(f: Facts) -> tuple[str, str]:
    found: dict[str, set[str]] = {"buy": set(), "sell": set()}
    for x in f.ifs:
        side = "buy" if _buys(x.body) else "sell" if _sells(x.body) else None
        for c in ast.walk(x.test) if side else ():
            if isinstance(c, ast.Compare) and len(c.ops) == 1 and type(c.ops[0]) in (ast.Gt, ast.GtE, ast.Lt, ast.LtE):
                a, b, over = flat(c.left), flat(c.comparators[0]), isinstance(c.ops[0], ast.Gt | ast.GtE)
                if is_average(a) == is_average(b) or any(w in a or w in b for w in BEFORE):
                    continue
                found[side].add("up" if over == is_average(b) else "down")
    one = lambda s: "any" if len(s) > 1 else next(iter(s), "unresolved")
    return one(found["buy"]), one(found["sell"])


SETTINGS = "status string, rsi_smoothing string, warmup string, warmup_bars string, a_exec string, same_bar_reentry string, input_field string, rsi_exit string, cross_timing string, buy_dir string, sell_dir string, streak_op string, streak double"


def read_settings(text: str | None) -> tuple:
    """The degrees of freedom of a program, as SETTINGS names them; null where it can't be parsed."""
    clean = sanitize(text) if text else None
    try:
        tree = ast.parse(clean) if clean is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is None:
        return ("unlexable" if clean is None else "unparsable", *[None] * 12)
    try:
        f = Facts(tree)
        field = next((NORMALIZATION[b] for a, b in sorted(f.attributes) if a == "datanormalizationmode" and b in NORMALIZATION), "adjusted")
        streaks = tests_of(tree, "streak", constants(tree), True)
        op, streak = next(iter(streaks)) if len(streaks) == 1 else ("mixed" if streaks else None, None)
        return ("ok", _smoothing(f), *_warmup(f), _execution(f), _reentry(f), field, _rsi_exit(f, tree), _timing(f, tree), *_directions(f), op, streak)
    except RecursionError:
        return ("unparsable", *[None] * 12)


#: Programs that a worker remembers with their settings, and how long a text may be for that.
REMEMBERED, SHORT = 4096, 16_384


@lru_cache(REMEMBERED)
def _known_settings(program: str) -> tuple:
    return read_settings(program)


def settings(program: str | Column) -> Column:
    """A struct of SETTINGS. A program that a worker has read before isn't parsed again."""
    read = lambda p: _known_settings(p) if p is not None and len(p) <= SHORT else read_settings(p)
    return F.pandas_udf(lambda programs: pd.DataFrame([read(p) for p in programs], columns=[x.split()[0] for x in SETTINGS.split(", ")]), SETTINGS)(program)


def _rows(programs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p) for p in programs], columns=["status", "kind", "period", "comparator", "threshold"])


def features(program: str | Column) -> Column:
    """A struct of status, kind, period, comparator and threshold."""
    return F.pandas_udf(_rows, "status string, kind string, period double, comparator string, threshold double")(program)
