import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tools import messy, messy_rows, nothing  # noqa: E402, F401
