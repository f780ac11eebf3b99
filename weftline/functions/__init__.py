"""The expression language: syntax, a plain evaluator, and compilation to Spark columns."""

from .columns import Typed, compile_expr, env_of, failure, predicate
from .evaluate import ExprError, evaluate
from .syntax import ParseError, parse, pretty

__all__ = ["ExprError", "ParseError", "Typed", "compile_expr", "env_of", "evaluate", "failure", "parse", "predicate", "pretty"]
