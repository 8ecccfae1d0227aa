"""The corpus pipeline: stages of the training-data operators over documents."""
from clausework.llm.pipeline import ORACLE_SQL, STAGES, run
