"""All operators by name."""

from millrace.operators.bayes import BernoulliNB, GaussianNB, MultinomialNB
from millrace.operators.cluster import DBSCAN, AgglomerativeClustering, GaussianMixture, KMeans, SpectralClustering
from millrace.operators.decomposition import NMF, PCA, TSNE, FastICA, LinearDiscriminantAnalysis
from millrace.operators.kernels import SVC, GaussianProcessRegressor, LinearSVC
from millrace.operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from millrace.operators.neighbors import KNNClassifier, KNNRegressor
from millrace.operators.neural import MLPClassifier, MLPRegressor
from millrace.operators.preprocessing import LabelEncoder, MinMaxScaler, OneHotEncoder, StandardScaler
from millrace.operators.splits import KFold, StratifiedKFold, cross_val_score
from millrace.operators.trees import (
    AdaBoostClassifier,
    DecisionTreeClassifier,
    ExtraTreesClassifier,
    GradientBoostingClassifier,
    GradientBoostingRegressor,
    IsolationForest,
    RandomForestClassifier,
)
from millrace.operators.voting import VotingClassifier

__all__ = [
    "AdaBoostClassifier", "AgglomerativeClustering", "BernoulliNB", "DBSCAN", "DecisionTreeClassifier", "ElasticNet", "ExtraTreesClassifier",
    "FastICA", "GaussianMixture", "GaussianNB", "GaussianProcessRegressor", "GradientBoostingClassifier", "GradientBoostingRegressor",
    "IsolationForest", "KFold", "KMeans", "KNNClassifier", "KNNRegressor", "LabelEncoder", "Lasso", "LinearDiscriminantAnalysis", "LinearRegression",
    "LinearSVC", "LogisticRegression", "MLPClassifier", "MLPRegressor", "MinMaxScaler", "MultinomialNB", "NMF", "OneHotEncoder", "PCA",
    "RandomForestClassifier", "Ridge", "SVC", "SpectralClustering", "StandardScaler", "StratifiedKFold", "TSNE", "VotingClassifier", "cross_val_score",
]
