"""Proof that a running Python frame is in a loop that never ends."""

from __future__ import annotations

import dis
import signal
import sys
from types import FrameType

#: Instructions that only read variables and constants of their frame, reckon with them, set variables and jump.
PURE = {
    "NOP", "RESUME", "LOAD_CONST", "LOAD_FAST", "LOAD_FAST_CHECK", "LOAD_FAST_LOAD_FAST", "LOAD_DEREF", "STORE_FAST", "STORE_FAST_LOAD_FAST", "STORE_FAST_STORE_FAST", "POP_TOP", "COPY", "SWAP",
    "BINARY_SUBSCR", "BINARY_OP", "COMPARE_OP", "CONTAINS_OP", "UNARY_NEGATIVE", "UNARY_INVERT", "UNARY_NOT", "TO_BOOL",
    "POP_JUMP_IF_TRUE", "POP_JUMP_IF_FALSE", "POP_JUMP_IF_NONE", "POP_JUMP_IF_NOT_NONE", "JUMP_FORWARD", "JUMP_BACKWARD",
}
#: Arguments of BINARY_OP from here on work in place, which changes lists and dicts.
IN_PLACE = 13
SCALARS = {int, float, bool, str, bytes, type(None)}
#: Instructions that are followed, and values that are looked at, before a proof is given up.
STEPS, VALUES = 1000, 1000
#: Seconds of a core before the first look, and frames that a look itself may take.
FIRST_S, DEEP = 0.002, 50


def plain(values) -> bool:
    """Whether there are only scalars, lists, tuples and dicts, whose operators are known to have no effect."""
    todo = list(values)
    for x in todo:  # grows as it is walked
        if type(x) in (list, tuple, dict):
            if len(todo) + 2 * len(x) > VALUES:
                return False
            todo.extend(x)
            if type(x) is dict:
                todo.extend(x.values())
        elif type(x) not in SCALARS:
            return False
    return True


def same(a: object, b: object) -> bool:
    """Whether no pure instruction can tell a from b: 0.0 isn't -0.0, and a NaN or a container is only the same as itself."""
    return a is b or (type(a) is type(b) and type(a) in SCALARS and a == b and (type(a) is not float or repr(a) == repr(b)))


def alone() -> bool:
    """Whether nothing but the running code can change what it reads: no other thread, signal handler or tracer of Python's."""
    handlers = [signal.getsignal(s) for s in signal.valid_signals() - {signal.SIGALRM, signal.SIGVTALRM}]
    return len(sys._current_frames()) == 1 and sys.gettrace() is None and not any(callable(h) and h is not signal.default_int_handler for h in handlers)


def depth(frame: FrameType | None) -> int:
    n = 0
    while frame is not None:
        frame, n = frame.f_back, n + 1
    return n


class Follower:
    """Follows a frame by instruction, and raises an exception in it when it is back in a state that it has been in.

    The state is the frame's variables at a jump backward.  All instructions between the two times are pure, and work on
    plain values that nothing else can change, so the frame goes the same round for ever.  Whatever else is met (a call,
    an exception, an iterator, an object, a state too large or a cycle too long) ends the proof, not the frame.
    Between `arm` and `disarm`, the frame that runs is followed each time the process has used as much more of a core.
    Work that waits uses none, so no system call is interrupted.
    """

    def __init__(self, endless: type[Exception]):
        self.endless = endless
        self.frame: FrameType | None = None
        self.armed = False

    def __enter__(self) -> Follower:
        self.before = signal.signal(signal.SIGVTALRM, self.look)
        signal.siginterrupt(signal.SIGVTALRM, False)
        return self

    def __exit__(self, *_: object) -> None:
        self.disarm()
        signal.signal(signal.SIGVTALRM, self.before)

    def arm(self) -> None:
        self.after, self.armed = FIRST_S, True
        signal.setitimer(signal.ITIMER_VIRTUAL, self.after)

    def disarm(self) -> None:
        self.armed = False
        signal.setitimer(signal.ITIMER_VIRTUAL, 0)
        self.stop()

    def look(self, _: int, frame: FrameType) -> None:
        if self.armed:  # a late signal must not set the timer again
            self.start(frame)
            self.after *= 2
            signal.setitimer(signal.ITIMER_VIRTUAL, self.after)

    def start(self, frame: FrameType) -> None:
        if self.frame is None and frame.f_globals is not globals() and depth(frame) + DEEP < sys.getrecursionlimit() and alone():
            self.frame, self.code, self.steps, self.visits, self.at, self.state = frame, frame.f_code.co_code, 0, 0, None, {}
            frame.f_trace, frame.f_trace_lines, frame.f_trace_opcodes = self.local, False, True
            sys.settrace(self.other)

    def stop(self) -> None:
        if self.frame is not None:
            sys.settrace(None)
            self.frame.f_trace, self.frame.f_trace_lines, self.frame.f_trace_opcodes = None, True, False
            self.frame = None

    def other(self, frame: FrameType, event: str, arg: object) -> None:
        self.stop()

    def local(self, frame: FrameType, event: str, arg: object):
        at = frame.f_lasti
        name = dis.opname[self.code[at]] if event == "opcode" else ""
        self.steps += 1
        if frame is not self.frame or name not in PURE or self.steps > STEPS or (name == "BINARY_OP" and self.code[at + 1] >= IN_PLACE):
            return self.stop()
        if name == "JUMP_BACKWARD":
            state = dict(frame.f_locals)
            if at == self.at and state.keys() == self.state.keys() and all(same(x, self.state[k]) for k, x in state.items()):
                self.stop()
                raise self.endless
            self.visits += 1
            if self.visits & (self.visits - 1) == 0:  # a state kept for twice as long each time meets a cycle of any length
                if not plain(state.values()):
                    return self.stop()
                self.at, self.state = at, state
        return self.local
