"""Driver-side orchestration: tools with retries, and a run of steps whose trace is a table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TRACE = "step string, status string, error string, n_tries int, elapsed double"


class RetryableError(Exception):
    """What may work if tried again."""


@dataclass(frozen=True)
class Tool:
    """A function, the names of its required arguments, defaults for others, and how often to try again."""

    run: Callable
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    most_retries: int = 2


class Registry:
    def __init__(self, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.tools: dict[str, Tool] = {}
        self.wait, self.sleep = wait, sleep

    def add(self, name: str, tool: Tool) -> None:
        if name in self.tools:
            raise ValueError(f"{name} is registered already")
        self.tools[name] = tool

    def call(self, name: str, **arguments) -> dict:
        """success, result, error, retryable and retries; waits twice as long before each new try."""
        if (tool := self.tools.get(name)) is None:
            return {"success": False, "result": None, "error": f"no tool {name}", "retryable": False, "retries": 0}
        given = tool.defaults | arguments
        if missing := [r for r in tool.required if r not in given]:
            return {"success": False, "result": None, "error": f"missing {', '.join(missing)}", "retryable": False, "retries": 0}
        for k in range(tool.most_retries + 1):
            try:
                return {"success": True, "result": tool.run(**given), "error": None, "retryable": False, "retries": k}
            except RetryableError as e:
                if k == tool.most_retries:
                    return {"success": False, "result": None, "error": str(e), "retryable": True, "retries": k}
                self.sleep(self.wait * 2**k)
            except Exception as e:  # a tool's failure is its result
                return {"success": False, "result": None, "error": str(e), "retryable": False, "retries": k}


def run_steps(registry: Registry, steps: list[tuple[str, dict]], timeout: float, most: int, clock: Callable[[], float] = time.monotonic) -> tuple[list[tuple], list]:
    """Calls tools in order until one fails, time is up or ``most`` were called: trace rows and results."""
    began, trace, results = clock(), [], []
    for i, (name, arguments) in enumerate(steps):
        if clock() - began > timeout or i >= most:
            trace.append((name, "timeout" if clock() - began > timeout else "max_iterations", None, 0, 0.0))
            break
        at = clock()
        got = registry.call(name, **arguments)
        trace.append((name, "ok" if got["success"] else "failed", got["error"], got["retries"] + 1, float(clock() - at)))
        results.append(got["result"])
        if not got["success"]:
            break
    return trace, results


def trace_table(spark: SparkSession, trace: list[tuple]) -> DataFrame:
    return spark.createDataFrame(trace, TRACE)
