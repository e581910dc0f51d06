"""A Levenshtein automaton intersected with a lexicon trie, made deterministic as it is used."""

from __future__ import annotations

from collections.abc import Iterable

#: States of the deterministic automaton that are kept; beyond this it starts again.
MOST_STATES = 10_000


class FuzzyLexicon:
    """Finds the lexicon term nearest to a word, within an edit distance that each term allows.

    ``terms`` are (text, is_prefix, max_edits).  A prefix term matches words that begin with it.
    A state of the automaton is a set of (trie node, edits so far); it is stepped by a character
    and remembered, so a word costs one look-up a character and stops at the first dead state.
    """

    def __init__(self, terms: Iterable[tuple[str, bool, int]]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]  # terms that end at the node
        self.allowed = [0]  # most edits that any term below the node allows
        for k, (text, _, edits) in enumerate(self.terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][ch]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node].append(k)
        self._restart()

    def _restart(self) -> None:
        self.known: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.first = self._state(frozenset({(0, 0)}), None)

    def _state(self, active: Iterable[tuple[int, int]], held: tuple[int, int] | None) -> int:
        """The number of the state with these nodes (after free deletions) and the best prefix hit so far."""
        todo, best = list(active), {}
        while todo:
            node, e = todo.pop()
            if e > self.allowed[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo.extend((child, e + 1) for child in self.children[node].values())
        hit = held
        for node, e in best.items():
            for k in self.ends[node]:
                if self.terms[k][1] and e <= self.terms[k][2] and (hit is None or (e, k) < (hit[1], hit[0])):
                    hit = (k, e)
        key = (frozenset(best.items()), hit)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append((tuple(best.items()), hit))
            self.moves.append({})
            whole = [(e, k) for node, e in best.items() for k in self.ends[node] if e <= self.terms[k][2]]
            found = min([*whole, *([(hit[1], hit[0])] if hit else [])], default=None)
            self.accept.append(found and (found[1], found[0]))
        return self.known[key]

    def _step(self, state: int, ch: str) -> int:
        active, held = self.sets[state]
        to = []
        for node, e in active:
            for c, child in self.children[node].items():
                to.append((child, e + (c != ch)))
            to.append((node, e + 1))
        target = self._state(to, held)
        self.moves[state][ch] = target
        return target

    def match(self, word: str) -> tuple[int, int] | None:
        """(index of the term, edits) of the best match, or None."""
        if len(self.sets) > MOST_STATES:
            self._restart()
        state, moves, sets = self.first, self.moves, self.sets
        for ch in word:
            target = moves[state].get(ch)
            state = self._step(state, ch) if target is None else target
            if not sets[state][0]:
                break
        return self.accept[state]
