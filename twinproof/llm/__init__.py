"""Operations of a training-data pipeline over documents, pages, vectors and chats.

Nothing else in the library imports this package. Its functions travel to the
Python workers by value, so executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
