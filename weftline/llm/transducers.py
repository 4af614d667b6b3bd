"""Small weighted finite-state transducers over token classes, and their composition."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Transducer:
    """Reads one symbol, writes one and adds a weight on each step.

    ``steps`` maps (state, symbol) to (next state, symbol written, weight). A symbol without a step is written as it
    is and leads to ``fallback[state]``, or leaves the state alone.
    """

    steps: dict
    fallback: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.steps.get((state, symbol)) or (self.fallback.get(state, state), symbol, 0.0)

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """The composition: what this one writes, the other reads. Only states that can be reached are built."""
        start, steps = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in symbols:
                to_a, middle, w1 = self.step(a, symbol)
                to_b, out, w2 = other.step(b, middle)
                steps[state, symbol] = ((to_a, to_b), out, w1 + w2)
                if (to_a, to_b) not in seen:
                    seen.add((to_a, to_b))
                    todo.append((to_a, to_b))
        return Transducer(steps, start=start)

    def run(self, symbols) -> tuple[str, float]:
        """What is written for a sequence of symbols, and the sum of the weights."""
        state, out, total = self.start, [], 0.0
        for symbol in symbols:
            state, written, weight = self.step(state, symbol)
            out.append(written)
            total += weight
        return "".join(out), total
