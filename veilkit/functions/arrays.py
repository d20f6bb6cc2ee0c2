"""Array idioms written as Spark SQL: local bindings and running totals without quadratic copying."""

from __future__ import annotations

BLOCK = 64


def let(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` inside `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pinned(value: str) -> str:
    """Keep an expensive projection where it is: Catalyst copies deterministic columns into every filter
    above them, which would run a scan once per use. The condition is always true."""
    return f"if(rand(1) + 1 >= 0, {value}, NULL)"


def _scan(block: str, start: str, step: str, inclusive: bool) -> str:
    kept = f"({step})" if inclusive else "st.run"
    return (f"aggregate({block}, named_struct('out', cast(array() AS array<int>), 'run', {start}), "
            f"(st, v) -> named_struct('out', array_append(st.out, {kept}), 'run', ({step}))).out")


def _blocked(arr: str, zero: str, step: str, inclusive: bool) -> str:
    """Prefix scan in blocks: appending copies an array, so no array longer than a block is grown."""
    blocks = f"transform(sequence(0, (size(pa) - 1) div {BLOCK}), pb -> slice(pa, pb * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform(pbs, pb -> aggregate(pb, {zero}, (t, v) -> {step.replace('st.run', 't')}))"
    per_block = f"flatten(transform(pbs, (pb, pi) -> {_scan('pb', 'pstart[pi]', step, inclusive)}))"
    return let("pa", arr, f"if(size(pa) <= {BLOCK}, {_scan('pa', zero, step, inclusive)}, "
               + let("pbs", blocks, let("pstart", _scan(totals, zero, step, False), per_block)) + ")")


def running_sum(arr: str) -> str:
    """array<int> -> sums of all earlier elements."""
    return _blocked(arr, "0", "st.run + v", inclusive=False)


def running_max(arr: str) -> str:
    """array<int> -> largest element so far, including the current one."""
    return _blocked(arr, "-1", "greatest(st.run, v)", inclusive=True)
