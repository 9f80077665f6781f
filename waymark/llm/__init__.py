"""Training-data operators: ten DataFrame-in, DataFrame-out building blocks.

Each module holds one operator with a general interface; `queries` derives the
registered queries from them.
"""
