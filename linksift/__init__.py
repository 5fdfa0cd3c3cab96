"""linksift: Spark jobs that turn noisy discovered links into a short, explained,
never-repeated list of picks, and report on how every source and stage performed.

Everything is DataFrame in, DataFrame out. The run's "now" is always the ``as_of``
argument; nothing reads the wall clock.
"""
