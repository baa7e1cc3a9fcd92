"""juryframe: rubric-based judgment over large sets of text units, as PySpark jobs."""

from juryframe.rubric import Policy, Question, Rubric, choice, scale, yes
from juryframe.session import build_session, cut_lineage

__all__ = ["Policy", "Question", "Rubric", "choice", "scale", "yes", "build_session", "cut_lineage"]
