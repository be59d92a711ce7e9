import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import assert_same, connection

__all__ = ["assert_same", "connection"]
