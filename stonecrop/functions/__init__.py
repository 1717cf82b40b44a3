""" """
